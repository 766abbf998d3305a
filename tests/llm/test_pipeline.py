from collections import Counter

import corpus_pipeline

from factorweave.llm.pii import QUERY_KEY, pseudonymize
from factorweave.llm.toxicity import toxicity


def test_contaminated_rows_of_null_and_repeated_ids(spark, docs, tmp_path):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, item), (None, "clean without id"), (None, None), (1, item), (1, "clean text of a repeated id"), (1, item), (2, "clean"), (2, "clean"), (0, ""), (3, f"so {item} then")]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_contaminated(spark, docs(rows), str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((r for r in rows if item not in (r[1] or "")), key=repr)


def test_columns_that_operators_use_inside_stay(spark, sf):
    clash = "'mine' as score, 'p' as predicted, 7 as held_out, array('k') as pii_kinds, 'd' as restored, 5 as key, 'r' as rest, 'n' as `a.b`"
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", *clash.split(", ")).limit(60).cache()
    rows = lambda df: Counter(map(repr, df.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        own = (lambda df: df.drop("text", "n_chars")) if name == "pii" else (lambda df: df)
        assert rows(own(out)) <= rows(own(docs)) and out.count() > 0


def test_of_repeated_rows_one_is_chosen_by_its_other_columns(spark):
    rows = [(1, "same text", lang, None if lang == "b" else "s", 9) for lang in ("c", "a", "b", "a")] + [(None, "alone", None, None, None)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        got = sorted(map(tuple, corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()), key=repr)
        assert got == sorted([rows[1], rows[-1]], key=repr)


def test_each_stage_against_a_plain_one(spark, sf):
    """Every stage on what its predecessor kept of the smallest tables."""
    import importlib

    words = importlib.import_module("test_decontamination").words
    similar = importlib.import_module("test_similar_texts")
    read = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    docs, stages = read("documents").cache(), dict(corpus_pipeline.STAGES)
    columns = docs.columns
    rows = lambda df: Counter((r.doc_id, r.text) for r in df.collect())

    before = rows(docs)
    scored = {(r.doc_id, r.text): r.predicted for r in toxicity(docs, read("labels")).collect()}
    now = stages["toxicity"](spark, docs, sf).cache()
    assert now.columns == columns and rows(now) == Counter({k: n for k, n in before.items() if scored[k] == 0})

    held, before = now, rows(now)
    now = stages["near_duplicates"](spark, held, sf).cache()
    groups = similar.brute(list(before.elements()))
    assert now.columns == columns and rows(now) == Counter(min(g) for g in groups)

    held, before = now, rows(now)
    windows = set()
    for r in read("benchmark").collect():
        w = words(r.text)
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} if w else set()

    def contaminated(text):
        w, hit = words(text), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        return bool(hit) and 20 * len(hit) >= len(w)

    now = stages["decontamination"](spark, held, sf).cache()
    assert now.columns == columns and rows(now) == Counter({k: n for k, n in before.items() if not contaminated(k[1])}) != before

    held, before = now, rows(now)
    now = stages["pii"](spark, held, sf).cache()
    assert now.columns == columns and now.count() == held.count() and rows(now) != before
    assert rows(pseudonymize(now, QUERY_KEY, restore=True)) == before
    assert all(r.n_chars == len(r.text) for r in now.collect())

    lengths, packed = Counter(), stages["packing"](spark, now, sf).collect()
    for r in packed:
        lengths[r.doc_id] += r["size"]
    assert lengths == {i: len(t.split()) + 1 for i, t in rows(now)}
    bins = Counter()
    for r in packed:
        bins[r.bin, r.capacity] += r["size"]
    assert all(used <= cap for (_, cap), used in bins.items()) and len(bins) == len({b for b, _ in bins})
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf).collect())) == Counter(map(tuple, packed))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf).count() == 0
