"""Which pages need a browser: thin text or an application shell. Rendering is done elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame

from crawlsight.config import SHELL_TEXT, THIN_TEXT
from crawlsight.functions import html as H
from crawlsight.functions import text as X
from crawlsight.functions.sql import NO_STRINGS
from crawlsight.session import stage


def render_flags(fetches: DataFrame) -> DataFrame:
    """Adds ``thin``, ``spa_shell`` and ``needs_render``.

    Counts raw tags, unlike the shell flag of the page facts.
    """
    names = [c for c in fetches.columns if c != "html"]
    staged = (
        fetches.selectExpr(*names, f"{H.source_text('html')} as src")
        .selectExpr(*names, "src", f"{H.dom('src')} as dom")
        .selectExpr(
            *names,
            "dom",
            f"coalesce(length({H.text_without_noscript('dom')}), 0) as text_len",
            f"{H.level(H.headings('dom'), 1)} as h1",
            f"coalesce({H.fact_tags('dom')}, cast(array() as array<struct<k:string,n:array<string>,v:array<string>>>)) as tags",
        )
        .selectExpr(
            *names,
            "dom",
            "text_len",
            f"size(coalesce(h1, {NO_STRINGS})) + size({H.of_kind('tags', 'i')})"
            " + size(filter(tags, t -> t.k = 'a' and array_contains(t.n, 'href'))) as semantic",
        )
        .selectExpr(
            *names,
            f"text_len < {THIN_TEXT} as thin",
            f"coalesce(dom, '') = '' or (semantic = 0 and (text_len < {SHELL_TEXT} or {H.has_app_root('dom')})) as spa_shell",
        )
    )
    return staged.selectExpr(
        "*",
        f"not {X.filled('error')} and coalesce(status_code, 0) <> 0 and status_code < 400"
        " and (thin or spa_shell) as needs_render",
    )


def render_worklist(fetches: DataFrame) -> DataFrame:
    """Pages to send to a renderer.

    The flags are staged first: a filter straight on them would be moved in front
    of the parsing and repeat it.
    """
    flags = render_flags(fetches).select(
        "audit_id", "seed_url", "url", "page_ord", "thin", "spa_shell", "needs_render"
    )
    return stage(flags, "render_flags").filter("needs_render").drop("needs_render")


def with_rendered(fetches: DataFrame, rendered: DataFrame) -> DataFrame:
    """Fetches with the HTML that a renderer returned for ``(audit_id, url)``; empty results are ignored.

    Only pages of the worklist can have been rendered. Their keys are staged, so each page
    is parsed once; the page sources themselves meet the few rendered pages by key.
    """
    got = (
        rendered.filter(X.filled("html"))
        .join(render_worklist(fetches).select("audit_id", "url").distinct(), ["audit_id", "url"], "left_semi")
        .selectExpr("audit_id", "url", "html as rendered_html")
    )
    replaced = {
        "html": "coalesce(rendered_html, html)",
        "js_rendered": "js_rendered or rendered_html is not null",
        "content_length": "if(rendered_html is null, content_length, cast(octet_length(rendered_html) as bigint))",
    }
    rows = fetches.join(got, ["audit_id", "url"], "left")
    return rows.selectExpr(*[f"{replaced.get(c, c)} as {c}" for c in fetches.columns])
