import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphfold.llm import ann, ngram_join, suffix_dedup
from graphfold.llm.shingles import shingle_sets

SF = "/root/testdata/sf0.001"


def sets_by_hand(text, size):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def components_by_hand(rows, size=4, part=85, whole=100):
    sets, parent = {i: sets_by_hand(t, size) for i, t in rows if i is not None}, {}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and whole * both >= part * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def copies(seed, groups=8):
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        base = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 4))) for _ in range(rng.choice([5, 12, 60, 150]))]
        for _ in range(rng.randint(1, 7)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                at = rng.randrange(len(w))
                if rng.random() < 0.5:
                    w[at] = rng.choice("xyz")
                else:
                    w.insert(at, rng.choice("xyz"))
            rows.append(" ".join(w))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_join_matches_all_pairs(spark, seed):
    rows = copies(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components_by_hand(rows)
    assert len({c for _, c in got.values()}) < len(rows)


@pytest.mark.parametrize(("stars", "more"), [(0, 0), (2, 0), (0, 3), (2, 3)])
def test_chunks_of_a_block_meet(spark, monkeypatch, stars, more):
    monkeypatch.setattr(ngram_join, "CHUNK", 3)
    monkeypatch.setattr(ngram_join, "STAR_CHUNK", 3)
    monkeypatch.setattr(ngram_join, "STARS", stars)
    monkeypatch.setattr(ngram_join, "MORE", more)
    monkeypatch.setattr(ngram_join, "COMMON", 2 if stars else 10_000)
    rows = copies(5, 4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components_by_hand(rows)


def near_copies(group, seed=7):
    """A group of near copies of one text, each with a word of its own, and as many other texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, rows = [word() for _ in range(200)], []
    for _ in range(group):
        w = list(base)
        w[rng.randrange(200)] = word()
        rows += [" ".join(w), " ".join(word() for _ in range(50))]
    return list(enumerate(rows))


def test_rows_grow_with_a_group_not_with_its_square(spark, monkeypatch):
    made, write = {}, ngram_join.materialize

    def counted(df, name):
        out = write(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(ngram_join, "materialize", counted)
    seen = []
    for group in (20, 100):
        made.clear()
        got = ngram_join.join(spark.createDataFrame(near_copies(group), "doc_id long, text string")).collect()
        assert len({r["component_id"] for r in got if r["doc_id"] % 2 == 0}) == 1
        seen.append({k: made.get(k, 0) for k in ("join_stars", "join_blocks", "join_hopeful", "join_links")})
    assert all(large <= 6 * max(small, 20) for small, large in zip(seen[0].values(), seen[1].values(), strict=True))


def of_template(many, least, seed=11):
    """Texts of `least` to 34 words of their own before a template of 200 n-grams, and how many words each has of its own."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    template, rows = [word() for _ in range(203)], []
    for i in range(many):
        k = rng.randint(least, 34)
        rows.append((i, k, " ".join([word() for _ in range(k)] + template)))
    return rows


def test_texts_of_a_template_do_not_meet(spark, monkeypatch):
    """Thousands of texts that share 86 to 91 % with a template, none 85 % alike, at shipped settings: no rows at all are
    left to compare, where chunks of one block would pair all of them."""
    made, write = {}, ngram_join.materialize

    def counted(df, name):
        out = write(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(ngram_join, "materialize", counted)
    rows = of_template(3000, 20)
    got = ngram_join.join(spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (200 + k, i) for i, k, _ in rows}
    assert not any(made[k] for k in ("join_lists", "join_stars", "join_blocks", "join_hopeful"))


def test_rows_of_a_template_class_are_not_paired_by_chunks(spark, monkeypatch):
    """Thousands of texts of 1 to 34 words of their own beside a template, at shipped settings: those of 35 words together
    link, so all are one class. Further rounds make it one label, and chunks do not repeat its rows."""
    dealt, deal = [], ngram_join._block_parts

    def counted(rows, large):
        out = deal(rows, large)
        dealt.append((rows.count(), out.count()))
        return out

    monkeypatch.setattr(ngram_join, "_block_parts", counted)
    rows = of_template(4000, 1)
    got = ngram_join.join(spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")).collect()
    assert min(k for _, k, _ in rows) == 1 and max(k for _, k, _ in rows) == 34
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (200 + k, 0) for i, k, _ in rows}
    (before, after), = dealt
    assert after <= 2 * before


@pytest.mark.parametrize("common", [10_000, 2])
def test_lists_keep_all_that_may_link(spark, common):
    """Postings with a partner stay, in batches of any size, and those of common grams too."""
    rng, t = random.Random(common), ngram_join.Threshold()
    rows = [(g, n, i, t.reach(n, n - rng.randrange(n - -(-85 * n // 100) + 1)), common == 2) for i, (g, n) in enumerate((rng.randrange(6), rng.randint(1, 60)) for _ in range(120))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r["id"] for r in ngram_join.lists(spark.createDataFrame(rows, "gram long, n long, id long, reach long, common boolean"), t).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {a[2] for a in rows for b in rows if a[2] != b[2] and a[0] == b[0] and a[1] <= b[3] and b[1] <= a[3]}
    assert want and want <= got
    assert len(got) < len(rows)


def test_join_of_odd_rows(spark, odd_docs, no_docs, texts):
    got = ngram_join.join(odd_docs).collect()
    want = components_by_hand(texts)
    assert len(got) == len(texts)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["n_shingles"] > 0
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    assert ngram_join.join(no_docs).count() == 0
    assert ngram_join.stage(spark, odd_docs, "").columns == odd_docs.columns


def test_stage_keeps_one_row_of_each_document(spark, odd_docs):
    clean = "a clean text that nothing else in this table is like at all"
    ided = odd_docs.where("doc_id = 3").first()
    extra = [(None, clean), (None, clean), (None, clean.upper()), (None, ided["text"]), (None, None), ((1 << 63) - 9, "an id with little room above")]
    more = spark.createDataFrame([(i, t, "en", "a", None, "clash", "clash", 7) for i, t in extra], odd_docs.schema)
    docs = odd_docs.union(more)
    got = ngram_join.stage(spark, docs, "").collect()
    want = components_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80, 100)
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == sorted(i for i, (_, c) in want.items() if c == i)
    loose = [r["text"] for r in got if r["doc_id"] is None]
    assert len(loose) == 3 and None in loose and sum(t is not None and t.lower() == clean for t in loose) == 1
    assert any(t and t.startswith("no id at all here") for t in loose)
    nameless = docs.withColumn("doc_id", F.lit(None).cast("long"))
    again = [r["text"] for r in ngram_join.stage(spark, nameless, "").collect()]
    words = lambda found: sorted(t.lower() for t in found if (t or "").split())
    assert len(words(again)) == len(words(r["text"] for r in got))


def test_shingles_do_not_depend_on_the_batch():
    rows = [t for _, t in copies(3)] + ["", " ", "A b C", "a B c"]
    whole = shingle_sets(rows)
    assert all((a == shingle_sets([t])[0]).all() for a, t in zip(whole, rows, strict=True))
    assert [len(s) for s in whole] == [len(sets_by_hand(t, 4)) for t in rows] and (whole[-1] == whole[-2]).all()


def test_trie_matches_plain_intersection():
    rng = np.random.default_rng(0)
    t = ngram_join.Threshold()
    base = np.unique(rng.integers(0, 1 << 40, 300).astype(np.uint64))
    members = [np.unique(np.concatenate([rng.permutation(base)[: len(base) - k], rng.integers(0, 1 << 40, k).astype(np.uint64)])) for k in (0, 3, 10, 20, 24, 30, 90)]
    want = [100 * len(np.intersect1d(base, m)) >= 85 * len(np.union1d(base, m)) for m in members]
    assert ngram_join.trie_join(base, members, t).tolist() == want and any(want) and not all(want)


def cut_by_hand(rows):
    first, out = {}, []
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for q in range(len(b) - 49):
            first.setdefault(b[q : q + 50], i)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if i is not None:
            for q in range(len(b) - 49):
                if first[b[q : q + 50]] < i:
                    gone[q : q + 50] = b"\1" * 50
        runs = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def dedup_rows(df):
    out = suffix_dedup.dedup(df).select("doc_id", "n_bytes", F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]), F.size("removed"), F.sha2("kept", 256))
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("small", [0, 1, 2])
def test_dedup_matches_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(suffix_dedup, "MOST_RANGES", 2 if small == 2 else 1 << 16)
        monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 3000)
        monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 4000)
        monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 1000)
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    passages = [text(n) for n in (49, 50, 51, 90, 400)]
    rows = [(i, text(rng.randint(0, 90)) + rng.choice(passages) + text(rng.randint(0, 60)) + rng.choice(passages)) for i in range(40)]
    rows += [(40, rows[3][1]), (41, rows[3][1]), (42, "a" * 500), (43, "a" * 300), (44, "ab" * 200 + "a" * 60)]
    rng.shuffle(rows)
    assert dedup_rows(spark.createDataFrame(rows, "doc_id long, text string")) == cut_by_hand(rows)


def test_dedup_of_odd_rows(spark, odd_docs, no_docs, texts):
    assert dedup_rows(odd_docs) == cut_by_hand(texts)
    assert suffix_dedup.dedup(no_docs).count() == 0


def strings(flat, at):
    return [flat[i : i + suffix_dedup.LENGTH].tobytes() for i in at.tolist()]


def test_suffix_arrays_are_sorted_by_bytes():
    rng = np.random.default_rng(3)
    for letters, n in ((2, 3000), (256, 500), (1, 90)):
        flat = np.concatenate([rng.integers(0, letters, n).astype(np.uint8)] * 2)
        at = rng.permutation(len(flat) - suffix_dedup.LENGTH + 1)
        order, new = suffix_dedup.suffix_array(np.concatenate([flat, np.zeros(8, np.uint8)]), at)
        got = strings(flat, at[order])
        assert got == sorted(got) and new.tolist() == [i == 0 or got[i] != got[i - 1] for i in range(len(got))]


def test_levels_stay_logarithmic():
    rng, levels, seen = np.random.default_rng(1), suffix_dedup.Levels(), set()
    for step in range(40):
        flat = rng.integers(0, 2 if step % 2 else 200, 160).astype(np.uint8)
        flat[:60] = np.arange(60)  # every batch repeats some strings
        at = np.arange(len(flat) - suffix_dedup.LENGTH + 1)
        got = levels.batch(np.full(len(at), step), flat, at)
        mine = strings(flat, at)
        assert got.tolist() == [x in seen for x in mine]
        seen |= set(mine)
    held = [x for level in levels.levels for x in strings(level.flat, level.at)]
    assert len(levels.levels) <= 7 and sorted(held) == sorted(seen)
    assert all(strings(a.flat, a.at) == sorted(strings(a.flat, a.at)) for a in levels.levels)


def test_ranges_of_ids(spark):
    rng = random.Random(6)
    for n in (0, 1, 2, 50):
        bounds = np.array(sorted({rng.randrange(-1000, 1000) for _ in range(n)}), np.int64)
        ids = [*range(-1100, 1100, 7), *bounds.tolist()]
        got = [r["n"] for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select(suffix_dedup._ranges_before(bounds, F.col("doc_id")).alias("n")).collect()]
        assert got == np.searchsorted(bounds, ids, side="right").tolist()


def neighbours_by_hand(rows, k=10, size=8):
    """Of each id that 100 divides, for the least vector of it: the nearest of all rows but that one."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v) and len(v) == size]
    ids, m, out = np.array([i for i, _ in good]), np.stack([v for _, v in good]), {}
    for i in {i for i, _ in good if i % 100 == 0}:
        mine = min((tuple(v), n) for n, (j, v) in enumerate(good) if j == i)[1]
        d = np.sqrt(((m - m[mine]) ** 2).sum(1))
        d[mine] = np.inf
        out[i] = [(int(ids[j]), float(d[j])) for j in np.lexsort((ids, d))[:k] if np.isfinite(d[j])]
    return out


def search_rows(spark, rows, **how):
    index = ann.build(ann.valid(spark.createDataFrame(rows, "vec_id long, vector array<double>, score string"), "vec_id", "vector"))
    out = {}
    for r in ann.search(index, index.entries.where(F.col("vec_id") % 100 == 0), **how).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_cells_that_hold_everything_give_the_exact_result(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(230)]
    rows += [(300, rows[7][1]), (301, rows[7][1]), (302, rows[7][1]), (303, None), (304, [0.0] * 8), (305, [float("nan")] + [1.0] * 7), (306, [None] + [1.0] * 7), (307, [1.0]), (308, [float("inf")] * 8), (None, [1.0] * 8)]
    rows += [rows[100], rows[100], (200, rng.normal(size=8).tolist())]  # an id with equal rows, and one with two vectors
    got, want = search_rows(spark, [(*r, "clash") for r in rows], enough=10_000), neighbours_by_hand(rows)
    assert got.keys() == want.keys() == {0, 100, 200, 300}
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12)
    assert [i for i, _ in got[100]][:2] == [100, 100]
    few = [(i, [float(i + 1)] * 8, "") for i in range(4)]
    assert [i for i, _ in search_rows(spark, few)[0]] == [1, 2, 3]
    assert ann.build(ann.valid(spark.createDataFrame([], "vec_id long, vector array<double>"), "vec_id", "vector")) is None


def recall(got, want):
    hit = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want]
    return sum(hit) / len(hit)


def test_recall_as_shipped(spark):
    at = "/root/testdata/sf0.1"
    e = spark.read.parquet(f"{at}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in e.select("vec_id", "embedding").collect()]
    got = {}
    for r in ann.op10_nearest(spark, at).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    index = ann.build(ann.valid(e, "vec_id", "embedding"))
    assert recall(got, neighbours_by_hand(rows, size=64)) >= 0.9 and index.enough < 0.7 * index.rows


def test_clustered_vectors_need_few_cells(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 8)) * 3
    rows = [(i, (centres[i % 30] + rng.normal(size=8)).tolist(), "") for i in range(3000)]
    index = ann.build(ann.valid(spark.createDataFrame(rows, "vec_id long, vector array<double>, score string"), "vec_id", "vector"))
    got, want = search_rows(spark, rows), neighbours_by_hand([r[:2] for r in rows])
    assert len(want) == 30 and recall(got, want) >= 0.9 and index.enough < 0.35 * index.rows


def test_walk_visits_cells_in_order():
    rng = np.random.default_rng(2)
    a, b = rng.random(9), rng.random(7)
    cells = ann.walk(a, b, np.ones(63, np.int64), 63)
    total = (a[:, None] + b).ravel()[cells]
    assert sorted(cells) == list(range(63)) and (np.diff(total) >= 0).all()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_join", "secret_scan", "mixing", "bpe"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        kept = {r["doc_id"] for r in rows}
        assert kept <= seen and len(rows) == len(kept)
        if name != "bpe":
            assert out.columns == docs.columns
        if name == "ngram_join":
            want = components_by_hand([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], 5, 80, 100)
            assert kept == {i for i, (_, c) in want.items() if c == i}
        if name == "secret_scan":
            assert kept == seen and not any("AKIA" in r["text"] for r in rows)
        if name != "bpe":
            docs, seen = spark.createDataFrame(rows, docs.schema), kept
