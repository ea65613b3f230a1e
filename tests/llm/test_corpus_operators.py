"""Mixing, scores, packing, shards, duplicates and the pipeline: odd rows, brute force, round trips."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from crawlsight.llm import exact, gam, lattice, mixing, near, packing, shards
from crawlsight.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- Exact -------------------------------------------------------------------


def groups_of(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append(r)
    return groups


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_exact_equals_python(request, table):
    df = request.getfixturevalue(table)
    want = []
    for text, rows in groups_of(df.collect()).items():
        keep = min(rows, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id))
        for r in rows:
            want.append((r.doc_id, keep.doc_id, len(rows), r.doc_id == keep.doc_id, hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, exact.dedup(df).collect()), key=repr) == sorted(want, key=repr)


def test_exact_keeps_one_row_of_each_group(odd, clashing, none, same):
    kept = exact.kept_documents(odd)
    assert Counter(re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept.collect()) == Counter(groups_of(odd.collect()).keys())
    same(kept, exact.kept_documents(clashing).select(odd.columns))
    assert exact.dedup(none).count() == 0 and exact.kept_documents(none).count() == 0


# --- Mixing ------------------------------------------------------------------


def test_mix_on_odd_rows(odd, clashing, none, same):
    got = mixing.mix(odd)
    same(got, mixing.mix(clashing))
    sizes = Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in odd.collect())
    assert Counter((r.doc_id, r["size"]) for r in got.collect()) == sizes
    assert all(0 <= r.taken <= 2 * r["size"] and r.target <= 2 * r.source_size for r in got.collect())
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


def test_mix_comes_near_its_targets(documents):
    rows = mixing.mix(documents).collect()
    source = {r.doc_id: r.source for r in documents.collect()}
    taken, target, largest = Counter(), {}, Counter()
    for r in rows:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        largest[source[r.doc_id]] = max(largest[source[r.doc_id]], r["size"])
    total = sum(r["size"] for r in rows)
    assert math.isclose(sum(target.values()), 1.5 * total)
    assert sum(taken.values()) <= 1.5 * total
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    open_ = {s: target[s] / w for s, w in zip(sorted(target), itertools.cycle((3, 1, 2)))}
    sizes = {source[r.doc_id]: r.source_size for r in rows}
    levels = {round(v, 6) for s, v in open_.items() if target[s] < 2 * sizes[s] - 1e-6}
    assert len(levels) == 1  # sources below their cap share by weight


def test_mixed_repeats_what_is_taken(documents):
    taken = {r.doc_id: r.taken // r["size"] for r in mixing.mix(documents).collect() if r["size"]}
    copies = Counter(r.doc_id for r in mixing.mixed(documents).select("doc_id").collect())
    assert all(copies[k] == n for k, n in taken.items())
    assert mixing.mixed(documents).columns == documents.columns


@pytest.mark.parametrize("hot", [7, None])
def test_mix_splits_rows_of_one_id(spark, hot):
    rows = [(hot, "w " * 10, "s") for _ in range(150)] + [(k, "w " * (k % 9), "s") for k in range(100, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    options = mixing.MixOptions(bucket_rows=20)
    got = mixing.mix(docs, options).collect()
    budget = 1.5 * sum(len(t.split()) for _, t, _ in rows)
    assert len(got) == len(rows) and budget - 10 < sum(r.taken for r in got) <= budget
    assert all(r.taken <= 2 * r["size"] for r in got)
    assert sorted(map(tuple, mixing.mix(docs, options).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    words = sum(len(r.text.split()) for r in mixing.mixed(docs, options).collect())
    assert words == sum(r.taken for r in got)


# --- Language model ----------------------------------------------------------


def model_of(rows):
    trained, texts = Counter(), []
    for r in rows:
        words = (r.text or "").encode().lower().split()
        held = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2
        texts.append((r.doc_id, held, words))
        if not held:
            trained.update([*words, None])
    return trained, texts


@pytest.mark.parametrize("hot", [200_000, 50, 0])
def test_scores_equal_python(documents, odd, hot):
    options = lattice.LatticeOptions(hot_words=hot)
    df = documents.filter("doc_id < 60").unionByName(odd)
    trained, texts = model_of(df.collect())
    n, v = sum(trained.values()), len(trained)
    pieces, logs, stop = lattice.piece_weights(lattice.word_counts(df, options), options)
    spell = lattice.Lattice(pieces, logs)
    want = []
    for doc_id, held, words in texts:
        base = sum(math.log10((trained.get(w, 0) + 1) / (n + v + 1)) for w in [*words, None])
        weights = [trained.get(w, 0) + v * math.exp(spell.one(b" " + w) + stop) for w in words] + [trained[None]]
        want.append((doc_id, held, len(words) + 1, sum(w in trained for w in [*words, None]), n, base, sum(math.log10(x / (n + v)) if x else spell.one(b" " + words[0]) for x in weights)))
    got = sorted(map(tuple, lattice.score(df, options).collect()), key=repr)
    for g, w in zip(got, sorted(want, key=repr), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9)
        if len([t for t in texts if t[0] == g[0]][0][2]) and max(map(len, [t for t in texts if t[0] == g[0]][0][2])) < 1000:
            assert math.isclose(g[6], w[6], rel_tol=1e-9)
        assert math.isfinite(g[6])


def test_lattice_sums_all_segmentations():
    logs = np.log([0.2, 0.1, 0.3, 0.15, 0.05])
    model = lattice.Lattice([b"a", b"b", b"ab", b"ba", b"aba"], logs)
    weights = dict(zip([b"a", b"b", b"ab", b"ba", b"aba"], np.exp(logs)))

    def brute(word):
        return 1.0 if not word else sum(w * brute(word[len(p) :]) for p, w in weights.items() if word.startswith(p))

    words = [bytes(x) for k in range(1, 8) for x in itertools.product(b"ab", repeat=k)]
    assert np.allclose(model.many(words), [math.log(brute(w)) for w in words])
    assert np.allclose([model.one(w) for w in words], model.many(words))


def test_scores_on_odd_rows(odd, clashing, none, spark):
    # Sums of floats may differ in the last place.
    a = sorted((tuple(x if not isinstance(x, float) else round(x, 6) for x in r) for r in lattice.score(odd).collect()), key=repr)
    b = sorted((tuple(x if not isinstance(x, float) else round(x, 6) for x in r) for r in lattice.score(clashing).collect()), key=repr)
    assert a == b
    assert lattice.score(none).count() == 0
    held = spark.createDataFrame([(k, "some words") for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2], "doc_id bigint, text string")
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in lattice.score(held).collect())


# --- Packing -----------------------------------------------------------------


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_packing_round_trip(request, table):
    df = request.getfixturevalue(table).repartition(3)
    tokenizer = Tokenizer.from_file(packing.public_path("byte_bpe_50k.json"))
    want = Counter((r.doc_id, tuple(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1])) for r in df.collect())
    rows = sorted(packing.pack(df).collect(), key=lambda r: (r.sequence_id, r.offset))
    place, stream, whole = 0, defaultdict(list), Counter()
    for r in rows:
        assert (r.sequence_id, r.offset) == divmod(place, 2048) and 0 < r.length <= 2048 - r.offset
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length
        place += r.length
        assert r.start == len(stream[r.doc_id])
        stream[r.doc_id] += ids
        if len(stream[r.doc_id]) == r.doc_tokens:
            whole[(r.doc_id, tuple(stream.pop(r.doc_id)))] += 1
    assert whole == want and not stream


def test_special_tokens_in_texts(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>"]
    tokenizer = Tokenizer.from_file(packing.public_path("byte_bpe_50k.json"))
    encode = packing.encoder(packing.PackOptions())
    assert [encode(t).tolist() for t in texts] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_on_odd_rows(clashing, none, odd, same):
    assert packing.pieces(none).count() == 0
    columns = ["doc_id", "length", "ids_crc32"]
    same(packing.pieces(odd.coalesce(1)).select(columns), packing.pieces(clashing.coalesce(1)).select(columns))


# --- Shards ------------------------------------------------------------------


@pytest.mark.parametrize("leaves", [16, 5, 1])
def test_shards_are_even_and_gapless(documents, leaves):
    got = shards.assign(documents, shards.ShardOptions(leaves=leaves)).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in documents.collect()}
    assert all(r["size"] == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in got)
    sizes, slots = Counter(), defaultdict(set)
    for r in got:
        sizes[r.shard] += r["size"]
        slots[r.shard].add(r.slot)
    assert sorted(sizes) == list(range(leaves))
    assert all(s == set(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == len(got)
    largest, fair = max(r["size"] for r in got), sum(sizes.values()) / leaves
    assert max(abs(v - fair) for v in sizes.values()) <= largest


def test_a_third_of_equal_rows_is_split(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same text', concat('text ', id, repeat('x', cast(id % 50 as int)))) as text")
    sizes = Counter()
    for r in shards.assign(df).collect():
        sizes[r.shard] += r["size"]
    assert max(sizes.values()) <= 1.02 * min(sizes.values())


def plain_tree(rows, leaves):
    """Leaf of every row by exact weighted medians; rows are dicts of the metadata."""
    wide = {d: max(1, max(r[d] for r in rows) - min(r[d] for r in rows)) for d in shards.DIMENSIONS}

    def cut(part, share):
        if share == 1 or not part:
            return [part]
        d = max(shards.DIMENSIONS, key=lambda d: (max(r[d] for r in part) - min(r[d] for r in part)) / wide[d])
        goal = sum(r["size"] for r in part) * (share // 2) / share
        weight = 0
        for key, group in itertools.groupby(sorted(part, key=lambda r: (r[d], r["tie"])), key=lambda r: (r[d], r["tie"])):
            own = sum(r["size"] for r in group)
            if weight + own >= goal:
                break
            weight += own
        nearer_with = weight + own - goal <= goal - weight
        left = [r for r in part if (r[d], r["tie"]) < key or (nearer_with and (r[d], r["tie"]) == key)]
        right = [r for r in part if not ((r[d], r["tie"]) < key or (nearer_with and (r[d], r["tie"]) == key))]
        return cut(left, share // 2) + cut(right, share - share // 2)

    return cut(rows, leaves)


@pytest.mark.parametrize("leaves", [2, 7, 16])
def test_shards_equal_a_plain_tree(documents, leaves):
    meta = [r.asDict() for r in documents.select(*shards._metadata()).collect()]
    wanted = [sorted(r["doc_id"] for r in part) for part in plain_tree(meta, leaves)]
    got = defaultdict(list)
    for r in shards.assign(documents, shards.ShardOptions(leaves=leaves, tolerance=0.0, bins=16)).collect():
        got[r.shard].append(r.doc_id)
    assert [sorted(got[k]) for k in range(leaves)] == wanted


def test_leaves_reach_the_target_bytes(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "concat(id, repeat('y', cast(id * 7 % 90 as int))) as text")
    total = sum(r["size"] for r in df.select(*shards._metadata()).collect())
    options = shards.ShardOptions(target_bytes=total // 40)
    sizes = Counter()
    for r in shards.assign(df, options).collect():
        sizes[r.shard] += r["size"]
    assert len(sizes) == -(-total // options.target_bytes)
    # A cut misses its goal by half a text at most, and by its tolerance.
    assert max(sizes.values()) <= 1.01 * options.target_bytes + 2 * 95
    assert Counter(r.shard for r in shards.sharded(df, options).collect()).keys() == sizes.keys()


def test_a_text_beyond_the_target_and_empty_tables(spark, none):
    df = spark.createDataFrame([(1, "z" * 5000), (2, "a"), (3, "b"), (4, "c")], "doc_id long, text string")
    got = {r.doc_id: r.shard for r in shards.assign(df, shards.ShardOptions(target_bytes=1000)).collect()}
    assert len(got) == 4 and got[1] not in {got[k] for k in (2, 3, 4)}
    assert shards.assign(none, shards.ShardOptions(target_bytes=1000)).count() == 0


def test_shards_on_odd_rows(odd, clashing, none, same):
    same(shards.assign(odd), shards.assign(clashing))
    assert shards.assign(none).count() == 0 and shards.sharded(none).count() == 0
    assert shards.assign(odd).count() == odd.count()
    got = Counter((r.doc_id, r.shard) for r in shards.assign(odd).collect())
    assert got == Counter((r.doc_id, r.shard) for r in shards.sharded(odd).select("doc_id", "shard").collect())


# --- Near duplicates ---------------------------------------------------------


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return set(zip(*(w[k:] for k in range(size)))) if len(w) >= size else ({tuple(w)} if w else set())


def brute_components(texts, size, similarity=0.8):
    sets = {k: shingles(t, size) for k, t in texts.items()}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(k for k in sets if sets[k]), 2):
        common = len(sets[a] & sets[b])
        if 100 * common >= 100 * similarity * (len(sets[a]) + len(sets[b]) - common):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize("size", [2, 5])
def test_near_equals_all_pairs(documents, size):
    texts = {r.doc_id: r.text for r in documents.collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(documents, near.NearOptions(shingle=size)).collect()}
    assert got == brute_components(texts, size)


@pytest.mark.parametrize("limit", [64, 2])
def test_near_family_with_links_at_the_bound(spark, limit):
    """Edited copies of a few texts, many of them just below or above 0.8; lists paired or in blocks."""
    pick = random.Random(11)
    texts, k = {}, 0
    for _ in range(3):
        words = [f"w{pick.randrange(500)}" for _ in range(120)]
        for _ in range(45):
            copy = [w if pick.random() > 0.06 else f"w{pick.randrange(500)}" for w in words]
            texts[k], k = " ".join(copy), k + 1
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    options = near.NearOptions(shingle=2, pair_list=limit, block=2000)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(df, options).collect()}
    assert got == brute_components(texts, 2)


@pytest.mark.parametrize("size", [2, 5])
def test_near_isolated_pairs_with_appended_words(spark, size):
    """Pairs that share nothing with other texts, one of them longer than the other by up to a quarter."""
    texts, k = {}, 0
    for n in range(55, 251, 15):
        for more in (0, 0.05, 0.1, 0.15, 0.2, 0.22, 0.25):
            words = [f"p{k}w{j}" for j in range(n + size - 1)]
            added = [f"p{k}a{j}" for j in range(max(1, int(n * more)))]
            texts[k], texts[k + 1], k = " ".join(words), " ".join(words + added), k + 2
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(df, near.NearOptions(shingle=size)).collect()}
    assert got == brute_components(texts, size)


def bags_around_a_leader(case, salt):
    """Word sets: leader 0 and 40 copies of it; 41 near the leader; 42 near 41 only; others that keep all lists but theirs long."""
    if case == "smaller":  # 42 within 41 within 0: similarity to the leader 41/60, ruled out by size at 0.8
        a, b, c = range(60), range(50), range(41)
    else:  # similarity to the leader exactly 0.6, both 0.8 similar to 41
        a, b, c = range(44), range(55), range(11, 55)
    frequent = (set(a) | set(b) | set(c)) - (set(a) & set(b) & set(c))
    sets = {0: set(a), 41: set(b), 42: set(c)}
    sets |= {k: {*a, f"own{k}"} for k in range(1, 41)}
    sets |= {k: {*frequent, *(f"other{k}x{j}" for j in range(25))} for k in range(43, 103)}
    return {k: " ".join(f"{salt}{w}" for w in s) for k, s in sets.items()}


@pytest.mark.parametrize("case", ["smaller", "tie"])
def test_near_member_whose_distance_from_the_leader_is_wide(spark, case):
    """Several draws, since another leader of a list may find the link by chance."""
    for salt in "uvw":
        texts = bags_around_a_leader(case, salt)
        df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(df, near.NearOptions(shingle=1)).collect()}
        want = brute_components(texts, 1)
        assert want[42] == (len(texts[42].split()), 0)
        assert got == want


def test_near_on_odd_rows(odd, clashing, none, same):
    got = near.near_duplicates(odd)
    same(got, near.near_duplicates(clashing))
    assert near.near_duplicates(none).count() == 0
    by_id = defaultdict(list)
    for r in got.collect():
        by_id[r.doc_id].append(r)
    assert by_id[6][0].component_id == 5 and not by_id[6][0].kept and len(by_id[6]) == 2
    assert by_id[8][0].component_id == 7 and by_id[2][0].component_id == 2 and by_id[2][0].n_shingles == 0 and by_id[3][0].kept
    assert by_id[None][0].component_id is None and by_id[None][0].kept
    same(near.kept_documents(clashing).select(odd.columns), near.kept_documents(odd))


def test_components_of_chains(spark):
    pick = random.Random(4)
    order = list(range(200))
    pick.shuffle(order)
    edges = list(zip(order[:120], order[1:120])) + list(zip(order[120:], order[121:]))
    got = {r.id: r.root for r in near.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {k: min(part) for part in (order[:120], order[120:]) for k in part if k != min(part)}
    assert got == want


# --- Pipeline ----------------------------------------------------------------


def test_pipeline_equals_its_operators_on_plain_python(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = documents.columns
    steps = dict(corpus_pipeline.STAGES)
    kept = steps["quality classifier"](spark, documents, SF)
    assert kept.columns == columns
    rows = kept.collect()
    learned = {r.doc_id for r in labels.filter("quality = 0").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    assert learned and not learned & {r.doc_id for r in rows}
    assert {r.doc_id for r in rows} == {r.doc_id for r in gam.classify(documents, labels).filter("predicted = 1").collect()}
    single = [min(g, key=lambda r: (-len(r.text or ""), r.doc_id)) for g in groups_of(rows).values()]
    found = brute_components({r.doc_id: r.text for r in single}, 5)
    stay = {k for k, (_, root) in found.items() if k == root}
    alone = spark.createDataFrame([r for r in single if r.doc_id in stay], documents.schema)
    want = Counter(r.doc_id for r in mixing.mixed(alone).select("doc_id").collect())
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in got if r.start == 0) == want
    tokens = Counter()
    for r in got:
        tokens[r.sequence_id] += r.length
    assert all(tokens[k] == 2048 for k in sorted(tokens)[:-1])
    # The ids are there, and decode to the documents that stay.
    tokenizer = Tokenizer.from_file(packing.public_path("byte_bpe_50k.json"))
    text = {r.doc_id: r.text for r in alone.collect()}
    whole = [r for r in got if r.length == r.doc_tokens]
    for r in whole[:50]:
        assert tokenizer.decode(np.frombuffer(r.ids, "<u4")[:-1].tolist(), skip_special_tokens=False) == text[r.doc_id]
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)


@pytest.mark.parametrize("name", list(QUERIES))
def test_queries_run(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() == spark.read.parquet(f"{SF}/{'pages' if name.startswith(('op5_', 'op12_')) else 'documents'}.parquet").count() or name.startswith("op4_")


@pytest.mark.parametrize("name", list(ORACLES))
def test_queries_equal_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF).select(*columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)
