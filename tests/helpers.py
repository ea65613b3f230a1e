"""Pages put together from parts, and fetch records."""

from crawlsight.schema import FETCHES


def tag(name, text=None, /, **attrs):
    """An element; ``_`` ends a name that is a keyword, ``__`` stands for a hyphen or colon as HTML needs it."""
    pairs = "".join(f' {k.rstrip("_").replace("__", "-")}="{v}"' for k, v in attrs.items())
    return f"<{name}{pairs}>" + ("" if text is None else f"{text}</{name}>")


def html_page(head=(), body=(), **root):
    return tag("html", tag("head", "".join(head)) + tag("body", "".join(body)), **root)


def json_ld(text):
    return tag("script", text, type="application/ld+json")


# Parts for what the tests ask: each list holds one kind of fact.
TITLED = [tag("title", "Harbour tides for the week of the regatta")]
DESCRIBED = [tag("meta", name="description", content="High water &amp; low water"), tag("meta", name="robots", content="max-snippet:20,follow")]
SHARED = [tag("meta", property="og:title", content="Tides"), tag("meta", property="og:description", content="Water levels")]
CHIRPED = [tag("meta", name="twitter:title", content="Tides today")]
SIZED = [tag("meta", name="viewport", content="initial-scale=1")]
SETTLED = [tag("link", rel="preload", href="/tide.css"), tag("link", rel="canonical", href="/tides")]
TYPED = [json_ld('{"@graph":[{"@type":"Dataset"},{"@type":["Place","Dataset"]}],"@context":"x"}')]
OUTLINE = ["<!-- <h1>draft</h1> -->", tag("h2", "Tables"), tag("h1", "Tide <i>ta</i>ble"), tag("h3", "Springs")]
PICTURES = [
    tag("img", srcset="/neap.avif 1x, /neap2.avif 2x", alt=""), tag("img", data__src="spring.png"),
    tag("img", src="/quay.png", alt="Quay"), tag("noscript", "static " + tag("img", src="/fallback.png")),
]
LINKS = [
    tag("a", "Write", href="mailto:harbour@mail.example"), tag("a", "Moon", href="https://moon.example/phase/"),
    tag("a", "Berths", href="/berths"), tag("a", "Top", href="#top"), tag("a", "Rates", href="/berths#rates"), tag("a", "Menu", href="JavaScript:menu()"),
]
SCRIPTED = [tag("script", 'let h = "<h1>no</h1></p>";')]

TIDES_PAGE = html_page(
    [*SIZED, *DESCRIBED, *CHIRPED, *SHARED, *TYPED, *SETTLED, *TITLED], [*SCRIPTED, *LINKS, *OUTLINE, *PICTURES], lang="en"
)
SHARED_PAGE = html_page(SHARED, ["Hi"])
PLAIN_PAGE = html_page(body=[tag("p", "Nothing but one short line."), "<img src=/line.png>"])


def fetch(url, html=None, ord_=0, status=200, seed="https://ex.com/", audit="a1", **more):
    row = {
        "audit_id": audit, "seed_url": seed, "url": url, "final_url": url, "status_code": status,
        "html": html, "content_length": len((html or "").encode()), "redirect_chain": [],
        "error": None, "depth": 0, "elapsed_ms": 0.0, "js_rendered": False, "page_ord": ord_,
    }
    row.update(more)
    return tuple(row[f.name] for f in FETCHES.fields)


def fetches(spark, rows):
    return spark.createDataFrame(rows, FETCHES).coalesce(2)
