"""Every operator against a plain version of itself, on texts with nulls, blanks, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from quillgraph.llm import decontam, langid, license_scan, mil_quality, mixing, quality_rules, sharding, simhash, surrogates, token_count
from quillgraph.operators.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, score string, size string"
EN, DE = "the of and was in this with from the of anthe ", "der die und das nicht für schön über ein der "


def corpus():
    rng = random.Random(4)
    rows = []
    for i in range(60):
        words = (EN if i % 3 else DE).split()
        text = " ".join(rng.choice(words) + rng.choice(["", "x", "er"]) for _ in range(rng.choice([3, 60, 200])))
        rows.append((i, text, "en" if i % 3 else "de", ["a", "b", None][i % 5 % 3]))
    rows += [(60, rows[1][1], "en", "a"), (61, rows[1][1] + " end", "en", "a"), (61, rows[1][1] + " end", "en", "a")]
    rows += [(70, None, None, None), (71, "", "en", "a"), (72, "  \n\t ", "en", None), (73, "12 34", "en", "b"), (74, "word " * 30_000, "en", "a"), (None, "der und die", "de", "b"), (76, "IDENTICAL\nline\nline", None, "b"), (77, "é́ 漢字 𝔘 ▁▁ <s>", "de", "a")]
    return [(i, t, lang, s, 1, "clash", "clash", "clash") for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- 10: tokens


def model_path():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def test_token_counts_are_the_librarys(docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    got = [(r.text, r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.count_tokens(docs.withColumn("copy", docs.text).withColumnRenamed("text", "t").withColumnRenamed("copy", "text").drop("t").select("doc_id", "text", docs.source), model_path()).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()]
    assert len(got) >= 70
    for text, n_bytes, n_tokens, over in got:
        want = len(sp.encode(text or ""))
        assert (n_bytes, n_tokens, over) == (len((text or "").encode()), want, want > 4096)
    assert token_count.count_tokens(empty, model_path()).count() == 0
    clash = token_count.count_tokens(docs.withColumnRenamed("size", "n_tokens"), model_path())
    assert len(clash.columns) == len(set(clash.columns)) and clash.where("n_tokens is null").count() == 0


def test_chunk_maps_compose_to_the_whole():
    machine = token_count.Transducer(token_count.read_pieces(open(model_path(), "rb").read()))
    rng = random.Random(2)
    for _ in range(400):
        text = "".join(rng.choice("ab c\n▁ é𝔘0 the<s>") for _ in range(rng.randint(0, 60)))
        assert machine.count(text) == machine.count(text, chunk=rng.randint(1, 12)), repr(text)


def test_long_texts_are_counted_over_tasks(spark, docs):
    short = {(r.doc_id, r.n_bytes): (r.n_tokens, r.over_limit) for r in token_count.count_tokens(docs.select("doc_id", "text"), model_path()).collect()}
    for size in (1, 40):
        got = token_count.count_tokens(docs.select("doc_id", "text"), model_path(), chunk=size * 7, long_bytes=size)
        assert {(r.doc_id, r.n_bytes): (r.n_tokens, r.over_limit) for r in got.collect()} == short
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    texts = ["漢字仮名交じり文" * 400, "abcdefghij" * 500, "x" * 3000, "words and spaces  " * 300 + "\n\n end"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in token_count.count_tokens(rows, model_path(), chunk=97, long_bytes=100).collect():
        assert r.n_tokens == len(sp.encode(texts[r.doc_id]))


def test_bounded_tables_do_not_change_counts(monkeypatch):
    machine = token_count.Transducer(token_count.read_pieces(open(model_path(), "rb").read()))
    texts = [t for _, t, *_ in corpus() if t]
    whole = [machine.count(t) for t in texts]
    monkeypatch.setattr(token_count, "MAX_SEGMENTS", 3)
    monkeypatch.setattr(token_count, "MAX_STATES", 20)
    assert [token_count.Transducer(machine.rank).count(t) for t in texts] == whole


def test_unsupported_models_are_refused():
    with pytest.raises(ValueError):
        token_count.read_pieces(bytes([0x12, 0x02, 0x18, 0x01]))  # a unigram model


# --- 3: SimHash


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(fps, bits=4):
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(corpus())
    fps = {i: plain_fingerprint(t) for i, t, *_ in corpus() if i is not None}
    want = plain_classes(fps)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert r.fp & (2**64 - 1) == fps[r.doc_id]
            assert r.component_id == want[r.doc_id]
    assert simhash.near_duplicates(empty).count() == 0
    reps = simhash.representatives(simhash.fingerprints(docs))
    told = simhash.discards(reps, reps.count(), 4).first()
    assert told.met == told.discarded + told.verified and told.linked <= told.verified


def test_null_ids_still_link_others(spark):
    base = xxhash.xxh64_intdigest(b"base", 1)
    rows = [(1, base), (None, base ^ 0b1111), (2, base ^ 0b11111111)]
    prints = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64))) for i, f in rows], "doc_id long, fp long")
    reps = simhash.representatives(prints)
    assert len({r.component for r in components(simhash.similar_edges(reps, 3, 4)).collect()}) == 1


@pytest.mark.parametrize("n", [50, 3000])
def test_pivot_search_finds_every_link(spark, monkeypatch, n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 2**63, n // 10, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(n)], np.uint64)
    fps = np.unique(base[rng.integers(0, len(base), n)] ^ flips)
    monkeypatch.setattr(simhash, "SLICE", 40)
    reps = simhash.with_pivots(spark.createDataFrame([(int(f), i) for i, f in enumerate(fps.view(np.int64))], "fp long, rep long"))
    for size in (n, 10**9):  # both numbers of blocks
        found = {r.node: r.component for r in components(simhash.similar_edges(reps, size, 4)).collect()}
        parent = list(range(len(fps)))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for i in range(len(fps)):
            for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 4):
                a, b = find(i), find(i + 1 + int(j))
                parent[max(a, b)] = min(a, b)
        assert {i: find(i) for i in range(len(fps)) if find(i) != i} == found


def test_components_of_a_long_chain(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000) for i in range(300)] + [(5, 5), (7, 8)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, **{1000 + i: 1000 for i in range(1, 300)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 4: quality rules


def test_base_figures(docs, empty):
    got = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.judge(docs, ["doc_id", "size"]).collect())
    want = []
    for i, t, *_ in corpus():
        w = words(t)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j + k for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        want.append((i or -1, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)))
    assert got == sorted((a if a else -1, *rest) for a, *rest in want)
    assert quality_rules.judge(empty, ["doc_id"]).count() == 0


def test_adaptive_bounds_reject_the_odd_ones(spark):
    rng = random.Random(3)
    normal = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(120)), "en", "s") for i in range(200)]
    odd = [(900 + i, " ".join(f"w{rng.randrange(500)}###" for _ in range(120)), "en", "s") for i in range(3)]
    rows = spark.createDataFrame(normal + odd, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality_rules.judge(rows, ["doc_id"]).collect()}
    assert all(kept[i] for i, *_ in normal) and not any(kept[i] for i, *_ in odd)
    # sketches of parts add up to the sketch of the whole
    figures = quality_rules.with_ratios(quality_rules.base_figures(rows, ["doc_id", "lang", "source"]))
    cells = lambda df: Counter({(r.lang, r.source, r.ratio, r.bin): r.n for r in quality_rules.sketches(df, ["lang", "source"]).collect()})
    assert cells(figures.where("doc_id % 2 = 0")) + cells(figures.where("doc_id % 2 = 1")) == cells(figures)


def test_every_ratio_gets_bounds_of_its_group(spark):
    rng = random.Random(6)

    def text(source):
        length, symbols, repeats = (4, 0, 0) if source == "plain" else (8, 3, 2)
        lines = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(length - 1, length + 1))) for _ in range(15)) for _ in range(8)]
        for _ in range(rng.randint(0, symbols)):
            lines[rng.randrange(8)] += " ##"
        for _ in range(rng.randint(0, repeats)):
            lines.append(rng.choice(lines))
        return "\n".join(lines)

    rows = [(i, text(source), "en", source) for i, source in enumerate(["plain", "rich"] * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    figures = quality_rules.with_ratios(quality_rules.base_figures(docs, ["doc_id", "lang", "source"]))
    bounds = {r.g_source: r for r in quality_rules.thresholds(quality_rules.sketches(figures, ["lang", "source"])).collect()}
    for ratio in quality_rules.RATIOS:
        assert bounds["plain"][f"hi_{ratio}"] < bounds["rich"][f"hi_{ratio}"], ratio
    judged = quality_rules.judge(docs, ["doc_id"])
    assert judged.where("not kept").count() <= 4
    joined = quality_rules.judge(docs, ["doc_id"], max_broadcast=0)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, judged.collect()))


def test_quality_columns_that_clash_keep_their_values(docs):
    odd = docs.withColumnRenamed("score", "n_words").withColumnRenamed("size", "kept").withColumnRenamed("shard", "base_failed")
    assert quality_rules.judge(odd, odd.columns).count() == len(corpus())
    kept = quality_rules.filter_documents(odd)
    assert kept.columns == odd.columns and {(r.n_words, r["kept"], r.base_failed) for r in kept.collect()} == {("clash",) * 3}


# --- 6: sharding


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 10, 97, 1000):
        assert sorted(sharding.feistel(i, n, 7) for i in range(n)) == list(range(n))


def test_shards(docs, empty):
    rows = sharding.shard(docs, key=99).collect()
    n = len(corpus())
    assert len(rows) == n and sorted(r.row_number for r in rows) == list(range(n))
    for r in rows:
        p = sharding.feistel(r.row_number, n, 99)
        assert (r.shard, r.slot) == (p % 8, p // 8)
        text = (r.text or "").encode()
        assert (r["size"], r.text_crc32) == (len(text) + 1, zlib.crc32(text))
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = sharding.shard(docs.repartition(7), key=99).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert sharding.shard(empty).count() == 0


def test_shard_files(docs, tmp_path, spark):
    sharding.write_shards(sharding.shard(docs), f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == len(corpus())


# --- 7: decontamination


def bench_rows():
    c = {i: t for i, t, *_ in corpus() if i is not None}
    long_doc = max((t for i, t in c.items() if t and 150 < len(words(t)) < 400), key=len)
    return [(1, " ".join(words(long_doc)[20:45]).upper()), (2, "12, 34"), (3, None), (4, " .. "), (10, "12 34"), (5, "nothing like this anywhere at all in any of the documents here")]


def test_decontamination_matches_brute_force(spark, docs, empty):
    bench = spark.createDataFrame(bench_rows(), "item_id long, text string")
    want = sorted(decontam.brute_force([(i, t) for i, t, *_ in corpus()], bench_rows()), key=str)
    for limit in (256 << 20, 1):
        got = decontam.digest(decontam.scan(docs, bench, keep=["doc_id"], max_broadcast_bytes=limit))
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert any(w[5] for w in want)
    assert decontam.scan(empty, bench).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.scan(docs, none).where("n_hit > 0").count() == 0
    clean = decontam.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not w[5] for w in want)
    odd = docs.withColumnRenamed("size", "n_words").withColumnRenamed("shard", "spans").withColumnRenamed("score", "item_ids")
    for remove in ("documents", "spans"):
        out = decontam.decontaminate(odd, bench, remove=remove)
        assert out.columns == odd.columns and {(r.n_words, r.spans, r.item_ids) for r in out.collect()} == {("clash",) * 3}
    named = spark.createDataFrame([(f"i{i}", t) for i, t in bench_rows()], "item_id string, text string")
    assert {i for r in decontam.scan(docs, named).collect() for i in r.item_ids} <= {f"i{i}" for i, _ in bench_rows()}
    cut = decontam.decontaminate(docs, bench, remove="spans")
    assert cut.count() == docs.count() and decontam.scan(cut, bench).where("n_hit > 0").count() == 0
    assert hashlib.sha256(b"").hexdigest() in {w[4] for w in want}


# --- 9: mixing


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            break
        level = (total - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else weight[s] * level for s in names}
        capped |= over
    return {s: 2.0 * sizes[s] for s in names}


def test_mixing(docs, empty):
    rows = mixing.mix(docs, slots_per_source=64).collect()
    assert len(rows) == len(corpus())
    sizes, taken = Counter(), Counter()
    for _, t, _, s, *_ in corpus():
        sizes[s] += len(words(t))
    want = plain_targets(sizes)
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    block = -(-sum(map(round, want.values())) // (3 * 64))
    for s, target in want.items():
        assert target - block <= taken[s] <= target + 0.5
    assert all((r.slot is None) == (r.taken == 0) for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(5), slots_per_source=64).collect()))
    assert mixing.mix(empty).count() == 0
    for mixed in (mixing.apply_mix(docs, slots_per_source=64), mixing.apply_mix(empty)):
        assert mixed.columns == docs.columns


def test_the_mix_matches_a_plain_walk_through_its_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 30])), rng.choice(["a", "a", "b", None])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = {r.doc_id: (r.taken, r.slot) for r in mixing.mix(docs, slots_per_source=16).collect()}
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    names = sorted(sizes, key=lambda s: (s is None, s))
    tokens = {s: round(t) for s, t in plain_targets(sizes).items()}
    total = sum(tokens.values())
    block = -(-total // (16 * len(names)))
    edges, at = [], 0
    for s in names:
        edges.append((at / total, (at + tokens[s]) / total, s))
        at += tokens[s]
    slots = defaultdict(list)
    for i in range(-(-total // block)):
        u = i * mixing.GOLDEN - int(i * mixing.GOLDEN)
        slots[next(s for lo, hi, s in edges if lo <= u < hi)].append(i)
    for s in names:
        n = max(min(max(len(slots[s]), tokens[s] // block), -(-tokens[s] // block)), 1)
        line = [i for i, t, src in sorted(rows, key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()) if src == s for _ in words(t)]
        part = Counter(line[k % len(line)] for k in range(min(tokens[s], n * block)))
        for i, _, src in rows:
            if src == s:
                first = line.index(i) if i in part else 0
                want = (slots[s][first // block] if first // block < len(slots[s]) else (1 << 40) + first // block) if part[i] else None
                assert got[i] == (part[i], want)


def test_mixed_rows_keep_null_and_repeated_ids_and_clashing_columns(spark):
    rows = [(None, "a b c", "s", 1, "x"), (None, "d e", "s", 2, "y"), (4, "f g h", "s", 3, "z"), (4, "i", "t", 4, "u"), (5, None, "t", 5, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, slot int, size string")
    got = mixing.apply_mix(docs).collect()
    assert set(map(tuple, got)) == {r for r in rows if r[1]}
    assert max(Counter(map(tuple, got)).values()) <= 2


def test_schedule_keeps_every_prefix_near_the_shares(spark):
    plan = spark.createDataFrame([(1, 600), (2, 300), (3, 100), (4, 0)], "sid long, tokens long")
    order = [r.sid for r in mixing.schedule(plan, 600, 4).orderBy("slot").collect()]
    assert len(order) == 600
    for n in (50, 200, 600):
        for sid, part in ((1, 0.6), (2, 0.3), (3, 0.1)):
            assert abs(order[:n].count(sid) - part * n) <= 4
    ranks = mixing.schedule(plan, 600, 4).where("sid = 1").orderBy("slot").collect()
    assert [r["rank"] for r in ranks] == list(range(len(ranks)))


# --- 1: language


def test_backpropagation_agrees_with_differences():
    rng = np.random.default_rng(0)
    net = langid.Network(["a", "b"], hidden=4)
    x, y = rng.integers(60, 130, (12, 5)).astype(np.uint8), np.array([0, 1, 1, 0, 1])

    def loss():
        p, w = net._positions(net._states(x)), langid.IS_LETTER[x]
        return -(np.log(p[:, y, np.arange(5)]) * w).sum() / w.sum()

    grads = net._gradients(x, y)
    for param, grad in ((net.left.recur, grads[1]), (net.right.recur, grads[3]), (net.head, grads[4]), (net.left.table, grads[0])):
        i = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        keep, eps = param[i], 1e-2
        param[i] = keep + eps
        up = loss()
        param[i] = keep - eps
        down = loss()
        param[i] = keep
        assert (up - down) / (2 * eps) == pytest.approx(grad[i], rel=0.05, abs=1e-4)


def test_language_id(docs, empty):
    rows = {r.doc_id: r for r in langid.identify(docs, ["doc_id", "score", "lang"]).collect()}
    assert rows[70].lang_pred == rows[71].lang_pred == rows[72].lang_pred == rows[73].lang_pred == "und"
    known = [(r.lang_pred, r.lang) for i, r in rows.items() if i is not None and i < 60]
    assert sum(a == b for a, b in known) / len(known) > 0.9
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items() if i is not None)
    assert langid.identify(empty, ["doc_id"]).count() == 0
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and not {70, 71, 72, 73} & {r.doc_id for r in kept.collect()}


def test_language_scores_do_not_depend_on_neighbours():
    net = langid.Network(["a", "b"])
    texts = [t for _, t, *_ in corpus()]
    together = langid.predict(net, texts)
    apart = [langid.predict(net, [t]) for t in texts]
    assert together[0] == [a[0][0] for a in apart]
    assert together[1] == pytest.approx([a[1][0] for a in apart], abs=1e-5)
    assert len(net.labels("abc é")) == 6


def test_language_scores_equal_a_plain_walk():
    """Each byte's label probabilities by a plain loop over the text's windows, pooled over letters."""
    net = langid.Network(["a", "b", "c"])
    sig = lambda x: 1 / (1 + np.exp(-x))

    def states(part, data):
        k, state, out = part.hidden, np.zeros(part.hidden), []
        for byte in data:
            given, own = part.table[:, byte], part.recur @ state
            reset, keep = sig(given[:k] + own[:k]), sig(given[k : 2 * k] + own[k : 2 * k])
            fresh = np.tanh(given[2 * k :] + reset * own[2 * k :])
            state = keep * state + (1 - keep) * fresh
            out.append(state)
        return out

    for text in ("der und die " * 30, "é", "one 2 three", "x" * langid.WINDOW):
        raw, total = text.encode(), np.zeros(3)
        for at in range(0, len(raw), langid.WINDOW):
            data = raw[at : at + langid.WINDOW].ljust(langid.WINDOW, b"\0")
            for byte, left, right in zip(data, states(net.left, data), states(net.right, data[::-1])[::-1], strict=True):
                if byte >= 0x80 or chr(byte).isalpha():
                    scores = np.exp(net.head @ np.concatenate([left, right]) + net.bias[:, 0])
                    total += scores / scores.sum()
        (lang,), (score,) = langid.predict(net, [text])
        assert lang == "abc"[total.argmax()] and score == pytest.approx(total.max() / total.sum(), abs=1e-4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in langid.identify(docs, ["doc_id", "lang"]).collect() if r.held_out and r.lang is not None and r.lang_pred != "und"]
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = {r.doc_id: r for r in mil_quality.classify(docs, labels, ["doc_id"]).collect()}
    held = [(r.quality, scored[r.doc_id].predicted) for r in labels.collect() if r.quality is not None and r.doc_id in scored and scored[r.doc_id].held_out]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) > 0.95


def test_language_stage_keeps_clashing_values_and_learns_every_language(spark, docs):
    odd = docs.withColumnRenamed("size", "lang_pred").withColumnRenamed("shard", "held_out")
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and {(r.lang_pred, r.held_out, r.score) for r in kept.collect()} == {("clash",) * 3}
    many = spark.createDataFrame([(i, f"text of number {i} here", f"l{i:03d}") for i in range(130)], "doc_id long, text string, lang string")
    assert len(langid.training_sample(many, "text", "lang", "doc_id")[0]) == 130


# --- 8: quality


def test_passage_figures_do_not_depend_on_neighbours():
    texts = [(t or "").encode() for _, t, *_ in corpus()]
    p, counts = mil_quality.figures(texts)
    alone = mil_quality.Passages.join([mil_quality.figures([t])[0] for t in texts])
    assert np.allclose(p.x, alone.x) and counts.sum() == len(p) and not np.isnan(p.x).any()
    assert (p.grams == alone.grams).all() and (p.sizes == alone.sizes).all() and p.sizes.sum() == 2 * sum(len(t.split()) for t in texts)


def test_quality_gradients_agree_with_differences():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(EN.split()) for _ in range(rng.choice([5, 90, 150]))).encode() for _ in range(6)]
    p, counts = mil_quality.figures(texts)
    bags, y = np.repeat(np.arange(6), counts), np.array([0, 1, 1, 0, 1, 0])
    model = mil_quality.Model()
    model.constant = None

    def loss():
        q = model._parts(p, bags)[6]
        return -(y * np.log(q) + (1 - y) * np.log(1 - q)).mean()

    for param, grad in zip(model.parameters(), model._gradients(p, bags, y), strict=True):
        i = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        keep, eps = param[i], 1e-5
        param[i] = keep + eps
        up = loss()
        param[i] = keep - eps
        down = loss()
        param[i] = keep
        assert (up - down) / (2 * eps) == pytest.approx(grad[i], rel=1e-3, abs=1e-8)


def test_quality_scores_equal_a_plain_forward_pass():
    model = mil_quality.Model()
    model.constant = None
    texts = [(t or "").encode() for _, t, *_ in corpus()][:20]
    p, counts = mil_quality.figures(texts)
    got, at, first = model.score(p, counts), 0, 0
    for k, n in enumerate(counts):
        hidden, weights = [], []
        for i in range(at, at + n):
            grams = p.grams[first : first + p.sizes[i]]
            first += p.sizes[i]
            mean = sum((model.table[g] for g in grams), np.zeros(mil_quality.EMBED)) / max(1, len(grams))
            h = np.tanh(np.concatenate([p.x[i], mean]) @ model.enc)
            hidden.append(h)
            weights.append(np.exp(np.tanh(h @ model.att_v) / (1 + np.exp(-(h @ model.att_u))) @ model.att_w))
        z = sum(w * h for w, h in zip(weights, hidden, strict=True)) / sum(weights)
        assert got[k] == pytest.approx(1 / (1 + np.exp(-(z @ model.out))), abs=1e-6)
        at += n


def test_quality_model(spark, docs, empty):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        good = i % 4 > 0
        rows.append((i, " ".join(rng.choice(EN.split()) + ("" if good else "###") for _ in range(rng.randint(20, 300))), int(good)))
    texts = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], None) for r in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in mil_quality.classify(texts, labels, ["doc_id"]).collect()}
    held = [(r.predicted, rows[i][2]) for i, r in got.items() if r.held_out]
    assert held and all(a == b for a, b in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert mil_quality.classify(docs.withColumnRenamed("shard", "held_out"), labels, ["doc_id", "score", "held_out"]).count() == len(corpus())
    assert mil_quality.classify(empty, labels, ["doc_id"]).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in mil_quality.classify(docs, none, ["doc_id"]).collect()} == {0.5}


# --- 2: licenses


@pytest.mark.parametrize("name", sorted({t[0] for t in license_scan.TEMPLATES}))
def test_every_template_finds_itself(name):
    scanner = license_scan.Scanner()
    for known, wording, _ in license_scan.TEMPLATES:
        if known == name:
            for text in (wording, f"before\n{wording.upper()}\nafter", "x " * 500 + "\n" + wording):
                assert [m["license"] for m in scanner.scan(text)[1]] == [name], text


def test_license_scan(spark, docs, empty):
    scanner = license_scan.Scanner()
    assert scanner.scan("A licence to write about licenses and permission.")[1] == []
    assert scanner.scan("Licensed under CC BY 4.0.\nLicensed under CC BY-NC 4.0.")[0] == 3
    assert [m["license"] for m in scanner.scan("Licensed under CC BY 4.0.\nLicensed under CC BY-NC 4.0.")[1]] == ["CC-BY-4.0", "CC-BY-NC-4.0"]
    changed = scanner.scan("Licensed under the Apache Software License, Version 2.0!")[1]
    assert changed[0]["license"] == "Apache-2.0" and "software" in changed[0]["diff"]
    assert scanner.scan(None) == scanner.scan("") == (0, [])
    assert license_scan.scan(docs, docs.columns).count() == len(corpus())
    assert license_scan.scan(empty, ["doc_id"]).count() == 0


# --- 5: surrogates


PEOPLE = "Mr John Smith met Mrs. Anna Petrova; Mr JOHN SMITH. Госпожа Иванова wrote to a.b@mail.example.com and A.B@mail.example.com from 10.0.0.1, call (555) 123-4567 or +1 555-123-4567, card 4111-1111-1111-1111, token = \"abcdef0123456789abcdef\", 123-45-6789."


def test_surrogates_keep_form_and_coreference():
    out, counts = surrogates.rewrite(PEOPLE, b"k", {})
    assert counts["given"] == 3 and counts["surname"] == 4 and counts["email"] == counts["phone"] == 2 and sum(counts.values()) == 15
    for secret in ("Smith", "Petrova", "a.b@", "10.0.0.1", "123-4567", "4111", "abcdef", "123-45-6789", "Иванова"):
        assert secret not in out
    found = lambda text, kind: [text[a:b] for a, b, k, _ in surrogates.find(text) if k == kind]
    assert found(out, "surname")[2].lower() == found(out, "surname")[0].lower() != "smith"
    assert found(out, "email")[0].lower() == found(out, "email")[1].lower()
    assert re.sub(r"\D", "", found(out, "phone")[0]) == re.sub(r"\D", "", found(out, "phone")[1])[-10:]
    assert surrogates.luhn(re.sub(r"\D", "", found(out, "card")[0])) and re.search("Госпожа [А-Я][а-я]+ова ", out)
    assert found(out, "ip")[0].startswith("10.")
    assert surrogates.rewrite(PEOPLE, b"other", {})[0] != out


def swapped(text):
    """The words of a text and of its surrogate, side by side."""
    out, _ = surrogates.rewrite(text, b"k", {})
    assert len(out.split()) == len(text.split())
    return dict(zip(text.split(), out.split(), strict=True)), out


def test_names_keep_surname_gender_and_format():
    by, out = swapped("Frau Anna Müller kam , Frau Müller blieb , Anna Müller schlief")
    assert out.count(by["Müller"]) == 3 and out.count(by["Anna"]) == 2 and by["Frau"] == "Frau" and by["Anna"].endswith("a")
    by, out = swapped("Mr John Smith left , Mr Smith slept , then Smith called John Smith")
    assert out.count(by["Smith"]) == 4 and by["John"].endswith("n") and "Smith" not in out
    by, out = swapped("Dr. Jane Roe and John Smith")
    assert by["Dr."] == "Dr." and by["Jane"].endswith("a") and not {"Jane", "Roe", "John", "Smith"} & set(out.split())
    by, out = swapped("Ms Anna-Lena O'Brien")
    assert re.fullmatch(r"[A-Z][a-z]{2}a-[A-Z][a-z]{2}a", by["Anna-Lena"]) and re.fullmatch(r"[A-Z]'[A-Z][a-z]{4}", by["O'Brien"])
    by, out = swapped("Госпожа Иванова , Господин Иванов")
    assert by["Иванова"] == by["Иванов"] + "а" != "Иванова"
    for plain in ("Mark my words. The end is near.", "He met the Queen of Spades", "secret: nobody knows"):
        assert surrogates.rewrite(plain, b"k", {})[0] == plain


def test_checksums_dates_streets_and_secrets():
    check = lambda v: int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1
    for account in ("DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19", "FR1420041010050500013M02606"):
        out, _ = surrogates.rewrite(account, b"k", {})
        assert out != account and check(out.replace(" ", "")) and [c.isdigit() for c in out] [4:] == [c.isdigit() for c in account][4:]
    assert not check(surrogates.rewrite("DE88370400440532013000", b"k", {})[0])
    out, counts = surrogates.rewrite("born on 12.03.1980, DOB: 1980-03-12, birth 03/25/1980, seen 12.03.1980", b"k", {})
    assert counts == {"birth": 3} and out.endswith("seen 12.03.1980")
    one, two = re.findall(r"\d{2}\.\d{2}\.\d{4}|\d{4}-\d{2}-\d{2}", out)[:2]
    assert one.split(".") == two.split("-")[::-1] != ["12", "03", "1980"]
    out, counts = surrogates.rewrite("12 Baker Street, Hauptstraße 5, 14 rue de Rivoli, Calle Mayor 3", b"k", {})
    assert counts == {"street": 4} and re.fullmatch(r"\d\d [A-Z]\w{4} Street, [A-Z]\w{4}straße \d, \d\d rue de [A-Z]\w{5}, Calle [A-Z]\w{4} \d", out)
    for secret in ('password = "hunter2abc"', "api_key: a1b2c3", "access_key = abcdefghijklmn"):
        assert surrogates.rewrite(secret, b"k", {})[1] == {"token": 1}
    for address, net in (("192.168.1.7", "192.168."), ("172.20.1.1", "172."), ("127.0.0.1", "127.")):
        assert surrogates.surrogate("ip", address, 0, b"k").startswith(net)
    assert all(surrogates.private_net(int.from_bytes(bytes(map(int, surrogates.surrogate("ip", f"8.8.{i}.1", 0, b"k").split("."))), "big")) == (0, 0) for i in range(250))


def test_permutations_are_distinct():
    for kind, names in (("ip", [f"1.2.{i // 250}.{i % 250}" for i in range(2000)]), ("card", [f"{i:016d}" for i in range(2000)]), ("ssn", [f"{i:09d}"[:3] + "-11-" + f"{i:04d}" for i in range(2000)])):
        made = [surrogates.surrogate(kind, n, 0, b"k") for n in names]
        assert len(set(made)) == len(set(names))


def test_collisions_are_resolved(spark):
    names = spark.createDataFrame([("surname", f"{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(600)] + [("ssn", "1-1-1"), ("ssn", "2-2-2")], "kind string, name string")
    rows = surrogates.assign(names, b"k").collect()
    assert len(rows) == 602 and len({(r.kind, r.made) for r in rows}) == 602
    assert not {(r.kind, r.made) for r in rows} & {(r.kind, r["name"]) for r in rows}


def test_surrogates_over_a_table(spark, docs, empty):
    rows = spark.createDataFrame([(1, PEOPLE, "x"), (2, PEOPLE, "x"), (3, None, "x"), (4, "", "x"), (5, "no data", "x")], "doc_id long, text string, n_entities string")
    for limit in (100_000, -1):
        got = {r.doc_id: r for r in surrogates.replace(rows, ["doc_id", "n_entities"], key=b"k", max_broadcast=limit).collect()}
        assert got[1].text == got[2].text != PEOPLE and got[1].n_entities == 15
        assert got[3].text is None and got[4].text == "" and got[5].text == "no data"
    assert surrogates.replace(docs, ["doc_id"], b"k").count() == len(corpus())
    assert surrogates.replace(empty, ["doc_id"], b"k").count() == 0


def test_surrogates_of_a_table_against_a_plain_check(spark):
    """Every entity of every text is gone, equal ones have equal surrogates, different ones different ones, none is a real entity."""
    rng = random.Random(9)
    mails = [f"user{i}@mail{i % 3}.example.com" for i in range(40)]
    cards = [f"{rng.randrange(10**16):016d}" for _ in range(40)]
    texts = [f"start {rng.choice(mails)} middle {rng.choice(cards)} end" for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = {}
    for r in surrogates.replace(rows, ["doc_id"], b"k").collect():
        old, new = texts[r.doc_id].split(), r.text.split()
        assert [old[0], old[2], old[4]] == [new[0], new[2], new[4]] and r.n_entities == 2
        for k in (1, 3):
            assert seen.setdefault(old[k], new[k]) == new[k]
    assert len(set(seen.values())) == len(seen) and not set(seen) & set(seen.values())


# --- the pipeline


def similar_classes(texts):
    """The smallest id of each class of texts linked by a 5-word shingle similarity of 0.8 or more, over all pairs."""
    sets, parent = {}, {i: i for i in texts}
    for i, t in texts.items():
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {find(i) for i in ids}


def test_pipeline(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["language", "near_duplicates", "decontaminate", "mix", "shards"] and cp.ORACLE_SQL is None
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    source = {r.doc_id: r for r in docs.collect()}
    one = cp.language(spark, docs, sf)
    assert one.columns == docs.columns
    left = {r.doc_id for r in one.collect()}
    two = {r.doc_id for r in cp.near_duplicates(spark, docs.where(docs.doc_id.isin(*left)), sf).collect()}
    assert two == similar_classes({i: source[i].text for i in left})
    hit = {r[0] for r in decontam.brute_force([(i, source[i].text) for i in two], bench) if r[5]}
    rows = cp.run(spark, sf).collect()
    assert {r.doc_id for r in rows} <= two - hit
    n = len(rows)
    assert sorted(r.slot * 8 + r.shard for r in rows) == list(range(n))
    sizes = Counter()
    for i in two - hit:
        sizes[source[i].source] += len(words(source[i].text))
    out = Counter()
    for r in rows:
        out[r.source] += len(words(r.text))
    longest = max(len(words(source[i].text)) for i in two - hit)
    for s, target in plain_targets(sizes).items():
        assert abs(out[s] - target) <= longest
