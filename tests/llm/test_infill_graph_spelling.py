"""Fill-in-middle, the vector graph and spelling variants against plain versions of themselves."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import infill, spelling, vector_graph

DOCS = "doc_id long, text string, n long, form string, output string, word string, root string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, 9, "clash", "clash", "clash", "clash") for i, t in rows], DOCS).repartition(parts)


# --- fill in the middle

TEXTS = [(i, " ".join(random.Random(i).choices(["the", "Of", "naïve", "x1", "\n", "漢字", "𝔘", "a-b", "<", "S>"], k=i % 40))) for i in range(120)]
TEXTS += [(200, None), (201, ""), (202, "has <P> inside"), (203, "<M>"), (204, "<S"), (205, "word " * 60_000), (206, "a" * 300_000), (None, "no id here"), (207, "same"), (207, "same"), (207, "other text, same id")]


def plain_infill(doc_id, text):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n, h = len(tokens), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(t) for t in (tokens[:lo], tokens[lo:hi], tokens[hi:]))
    return (n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}") if h4 % 100 < 20 else (n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}")


def test_infill_equals_the_token_lists_and_restores_every_text(spark):
    docs = frame(spark, TEXTS)
    out = infill.transform(docs, ["doc_id", "text", "form"])
    assert out.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = out.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_infill(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_infill_digest_and_empty_table(spark):
    got = {(r.doc_id, r.output_sha256, r.restored_sha256) for r in infill.digest(infill.transform(frame(spark, TEXTS), ["doc_id"])).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {(i, sha(plain_infill(i, t)[4]), sha(t or "")) for i, t in TEXTS}
    assert infill.digest(infill.transform(frame(spark, []), ["doc_id"])).count() == 0


def test_infill_matches_no_list_of_units():
    text = "ab, c" * 1000
    assert infill.count_units(text) == len(infill.UNIT.findall(text))
    assert infill.ends_of(text, 0, 0) == (0, 0)
    assert infill.ends_of(text, 4, 4) == (7, 7)
    assert infill.ends_of(text, 1, 3) == (2, 4)


# --- spelling variants


def plain_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    words = plain_words(rows)
    near = {w: [o for o in words if o != w and abs(len(o) - len(w)) <= 1 and one_apart(w, o)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o.encode()), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def spelling_rows():
    rng = random.Random(7)
    base = ["language", "straße", "größer", "señoría", "letters", "colour", "abcdef", "aabbcc", "ÀÉÎÕÜß", "mañana×"]
    words = []
    for w in base:
        words += [w] * 400
        for _ in range(12):
            at = rng.randrange(len(w))
            words += [rng.choice([w[:at] + w[at + 1 :], w[:at] + "q" + w[at:], w[:at] + "ê" + w[at + 1 :], w[:at] + w[at : at + 1] + w[at:]])] * rng.choice([1, 5, 6, 30, 80])
    words += ["languag"] * 80 + ["languagx"] * 80 + ["languages"] * 80 + ["langua"] * 10 + ["abcdfe"] * 60 + ["LANGUAGE"] * 30
    rng.shuffle(words)
    rows = [(i, " ".join(words[i * 40 : i * 40 + 40])) for i in range(len(words) // 40 + 1)]
    long = "".join(rng.choices("abcé", k=20_000))
    rows += [(900 + i, long) for i in range(30)] + [(940 + i, long[:777] + long[778:]) for i in range(6)]
    return rows + [(None, "language señoría " * 9), (700, None), (701, ""), (702, "12 34 !"), (3, rows[3][1]), (3, rows[3][1])]


def test_variants_equal_all_pairs(spark):
    rows = spelling_rows()
    got = {tuple(r) for r in spelling.variants(frame(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    want = plain_variants(rows)
    assert got == want
    assert sum(f is not None for _, f, *_ in want) > 20 and any(r != f and f for _, f, r, *_ in want)
    assert any(len(w) > 10_000 and f for w, f, *_ in want)


def test_variants_of_nothing(spark):
    assert spelling.variants(frame(spark, [])).count() == 0
    assert spelling.variants(frame(spark, [(1, None), (2, "too rare")])).count() == 0


def test_deletion_keys_meet_where_deletions_do():
    def plain(w):
        return {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}

    words = ["aabbcc", "abbcc", "abcabc", "bcabca", "aabbc", "ñandúx", "ñandú", "x" * 50, "x" * 49]
    for a in words:
        assert len(spelling.deletion_keys(a)) == len(plain(a))
        for b in words:
            assert bool(set(spelling.deletion_keys(a).tolist()) & set(spelling.deletion_keys(b).tolist())) == bool(plain(a) & plain(b))


def test_a_word_in_every_row_is_counted_where_it_is_read(spark):
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit("everywhere rather").alias("text")).repartition(8)
    counted = {r.word: r.n for r in spelling.count_words(docs).collect()}
    assert sum(counted.values()) >= 199_000 and counted["everywhere"] > 99_000


# --- vector graph

VECTORS = "vec_id long, embedding array<float>, n_links string, kept string"


def vector_rows(seed=1):
    rng = np.random.default_rng(seed)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    base = unit(rng.normal(size=(600, 16)))
    big = base[0] + 0.05 * rng.normal(size=(150, 16))
    pairs = base[1:60] + 0.06 * rng.normal(size=(59, 16))
    chain = np.array([[np.cos(0.3 * i), np.sin(0.3 * i)] + [0] * 14 for i in range(12)])
    x = np.concatenate([base, big, pairs, chain, base[100:140] * 3, base[100:110]])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x.astype(np.float32))]
    rows += [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [1.0, None] + [0.0] * 14), (5004, [float("nan")] * 16), (5005, [float("inf")] + [0.0] * 15)]
    rows += [(5010, [1.0, 0.0, 0.0]), (5011, [1.0, 0.001, 0.0]), (5012, [1.0] * 3), (None, rows[3][1]), (3, rows[3][1]), (7, rows[9][1])]
    random.Random(seed).shuffle(rows)
    return rows


def plain_links(rows, threshold=0.95):
    sound = [i for i, (_, v) in enumerate(rows) if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for length in {len(rows[i][1]) for i in sound}:
        some = [i for i in sound if len(rows[i][1]) == length]
        x = np.array([rows[i][1] for i in some], np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in np.argwhere(x @ x.T >= threshold):
            if a != b:
                links[some[a]].add(some[b])
    out, done = [], {}
    for i in range(len(rows)):
        if i not in done:
            reach, stack = set(), [i]
            while stack:
                k = stack.pop()
                if k not in reach:
                    reach.add(k)
                    stack += links[k]
            name = min((rows[k][0] for k in reach if rows[k][0] is not None), default=None)
            done |= dict.fromkeys(reach, name)
        out.append((rows[i][0], len(links[i]), done[i], rows[i][0] == done[i]))
    return Counter(out)


@pytest.mark.parametrize("cell_rows,shard_rows", [(2048, 16_384), (100, 16_384), (200, 120)])
def test_links_equal_all_pairs(spark, cell_rows, shard_rows):
    rows = vector_rows()
    report = []
    table = spark.createDataFrame([(i, v, "clash", "clash") for i, v in rows], VECTORS).repartition(4)
    got = vector_graph.near_duplicates(table, cell_rows=cell_rows, shard_rows=shard_rows, report=report)
    assert Counter(tuple(r) for r in got.collect()) == plain_links(rows)
    assert report[-1]["recall"] == 1.0 and (cell_rows == 2048 or max(r["cells"] for r in report) > 3)


def test_no_vectors_no_links(spark):
    assert vector_graph.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0
    lone = vector_graph.near_duplicates(spark.createDataFrame([(4, None, "", ""), (None, None, "", "")], VECTORS)).collect()
    assert {tuple(r) for r in lone} == {(4, 0, 4, True), (None, 0, None, True)}


def test_many_equal_vectors_are_one_node(spark):
    table = spark.range(100_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("vec_id"), F.array(F.lit(1.0), F.lit(0.5)).alias("embedding"))
    got = vector_graph.near_duplicates(table).groupBy("n_links", "component_id", "kept").count().collect()
    assert {tuple(r) for r in got} == {(99_999, 1, True, 1), (99_999, 1, False, 99_999)}


def test_pruning_keeps_the_nearest_and_what_it_does_not_cover():
    x = np.array([[1, 0], [np.cos(0.1), np.sin(0.1)], [np.cos(0.12), np.sin(0.12)], [0, 1], [np.cos(0.1), -np.sin(0.1)]], np.float32)
    kept = vector_graph.prune(x, np.array([0]), np.array([[3, 2, 1, 0, 4, -1, 1]]), degree=4)[0]
    assert kept[0] in (1, 4) and set(kept.tolist()) >= {1, 4} and 2 not in kept and 0 not in kept


def test_the_medoid_alone_leads_to_a_group_of_any_size():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 32))
    x[300:1000] = x[300] + 0.08 * rng.normal(size=(700, 32))
    x = vector_graph.units(x)
    graph = vector_graph.build(x.astype(np.float32), 5)
    q, r = vector_graph.Search(x, graph, 0.95).run(x[250:350], np.full(100, -1))
    true = np.argwhere(x[250:350] @ x.T >= 0.95)
    assert len(q) == len(true) and len(true) > 30_000
