"""Sketches, mixing, neighbours and the pipeline against brute force and SQL."""

import hashlib
import math
import random
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from corpus_data import SCHEMA, frame, prose, rows
from pyspark.sql import functions as F

from allocora.llm import mixing, neighbours, sketch


def dice(a, b):
    a, b = Counter(sketch.paragraphs(a)), Counter(sketch.paragraphs(b))
    total = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / total if total else 1.0


def test_likeness_is_exact():
    draw = random.Random(2)
    texts = [prose(draw, draw.randint(0, 400)) for _ in range(40)] + ["", None, "a. a. a. b. ", "a. b. c. " * 50, "x" * 5000]
    texts += [sketch.edited(a or "", b or "") for a, b in zip(texts, texts[1:], strict=False)]
    mine, others = (np.array(x) for x in zip(*((i, j) for i in range(len(texts)) for j in range(0, len(texts), 7)), strict=True))
    found = sketch.likeness(sketch.digests(texts), mine, others)
    assert found == pytest.approx([dice(texts[i], texts[j]) for i, j in zip(mine, others, strict=True)])


def test_fingerprints_tell_texts_apart():
    texts = [t for _, t, *_ in rows()]
    shown = sketch.fingerprints(texts)
    by_text = {}
    for text, s in zip(texts, shown, strict=True):
        assert by_text.setdefault(text or "", s) == s
    assert len(set(by_text.values())) == len(by_text)


@pytest.mark.parametrize("partitions", [1, 5])
def test_with_next(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", str(3 * partitions))
    data = [r for r in rows() if r[0] not in (None, 1008)] + [(1008, "one of them", "en", "s", 11)]
    found = {r["doc_id"]: r for r in sketch.with_next(frame(spark, data, partitions)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    ordered = sorted((i, t or "") for i, t, *_ in data)
    assert len(found) == len(data)
    for (i, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        r = found[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(dice(text, changed))
        assert r["near_next"] == pytest.approx(dice(text, following))
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (text == changed)


def test_with_next_of_few_rows(spark):
    one = sketch.with_next(frame(spark, [(1, "abc", None, None, 3)])).collect()
    assert [(r["near_next"], r["edited_sha256"]) for r in one] == [(1.0, hashlib.sha256(b"aba").hexdigest())]
    assert sketch.with_next(spark.createDataFrame([], SCHEMA)).count() == 0
    assert sketch.with_next(frame(spark)).count() == len(rows())


def in_duckdb(sql, **tables):
    db = duckdb.connect()
    for name, data in tables.items():
        db.register(name, data)
    return db.sql(sql).fetchall()


def mixed_rows(docs):
    found = mixing.with_copies(docs).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )
    return sorted(map(tuple, found.collect()), key=str)


@pytest.mark.parametrize("partitions", [1, 4])
def test_mixing_equals_sql(spark, partitions):
    docs = frame(spark, rows(), partitions)
    plain = docs.drop("size").select("doc_id", "text", "source").toPandas()
    plain["doc_id"] = plain["doc_id"].astype("Int64")
    expected = in_duckdb(mixing.ORACLE, documents=plain)
    assert mixed_rows(docs) == sorted(expected, key=str)


def waterfill(sizes):
    """Share by weight, cap, share the excess again, until nothing is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: 1 + at % 3 for at, s in enumerate(names)}
    capped = {}
    while True:
        left = sum(sizes.values()) - sum(capped.values())
        free = [s for s in names if s not in capped]
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        above = [s for s in free if share[s] > 3 * sizes[s]]
        if not above:
            return capped | share
        capped |= {s: 3 * sizes[s] for s in above}


@pytest.mark.parametrize("seed", range(6))
def test_targets_equal_sharing_again_and_again(spark, seed):
    draw = random.Random(seed)
    sizes = {f"s{k}é"[: draw.randint(1, 4)] + str(k): draw.choice([0, 1, 50, 1000, 100_000]) for k in range(draw.randint(1, 9))}
    sizes[None] = 7
    found = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    expected = waterfill(sizes)
    assert {r["source"]: r["target"] for r in found} == pytest.approx(expected)
    assert sum(r["target"] for r in found) == pytest.approx(sum(sizes.values()))


@pytest.mark.parametrize("sizes", [[100] * 6, [100, 200, 300], [100, 200, 300, 100, 200, 300, 1, 0]])
def test_tied_sources_share_alike(spark, sizes):
    sizes = {f"s{k}": n for k, n in enumerate(sizes)}
    found = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert {r["source"]: r["target"] for r in found} == pytest.approx(waterfill(sizes))
    assert sum(r["target"] for r in found) == pytest.approx(sum(sizes.values()))


def test_mix_comes_near_its_targets(spark):
    draw = random.Random(3)
    data = [(i, prose(draw, 20), "en", f"s{i % 5 * (i % 2)}", 0) for i in range(4000)]
    docs = frame(spark, data)
    taken = mixing.mix(docs)
    assert taken.columns == docs.columns and {r[0] for r in taken.select("size").distinct().collect()} == {"mine"}
    per_source = {r[0]: r[1] for r in taken.groupBy("source").agg(F.sum(mixing.word_count("text"))).collect()}
    for r in mixing.source_targets(docs.groupBy("source").agg(F.sum(mixing.word_count("text")).alias("source_size"))).collect():
        assert per_source[r["source"]] == pytest.approx(r["target"], rel=0.1)
    assert mixed_rows(docs) == mixed_rows(docs.repartition(7))
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def vectors(count=400, dim=12):
    draw = np.random.default_rng(6)
    table = draw.normal(size=(count, dim)).astype(np.float32)
    table[100:160] = table[7]
    out = [(i, v.tolist()) for i, v in enumerate(table)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * dim, [1.0] * (dim - 1) + [None], [nan] * dim, [inf] * dim, [1.0] * (dim + 1), [1e-20] * dim]
    out += [(1000 + 20 * k, v) for k, v in enumerate(odd)]
    return [*out, (None, [1.0] * dim), (3, table[3].tolist())]


@pytest.mark.parametrize("block", [2048, 16])
def test_neighbours_equal_sql(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    frame_ = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).repartition(3)
    found = sorted(map(tuple, neighbours.nearest(frame_, F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score").collect()))
    import pyarrow as pa

    table = pa.table({"vec_id": [i for i, _ in vectors()], "embedding": pa.array([v for _, v in vectors()], pa.list_(pa.float32()))})
    assert found == sorted(in_duckdb(neighbours.ORACLE, embeddings=table))


def test_neighbours_in_many_columns(spark):
    draw = np.random.default_rng(9)
    table = draw.normal(size=(20_000, 4)).round(2)
    table[::3] = table[0]  # one vector holds a third of all rows
    frame_ = spark.createDataFrame([(i, v) for i, v in enumerate(table.tolist())], "vec_id long, embedding array<double>")
    found = neighbours.nearest(frame_, F.col("vec_id") % 500 == 0, 5, cell_bytes=1)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in found.collect()}
    for q in range(0, 20_000, 500):
        score = neighbours.exact_scores(np.broadcast_to(table[q], table.shape), table)
        best = [i for i in np.lexsort((np.arange(len(score)), -score)) if i != q][:5]
        assert [got[q, r] for r in range(1, 6)] == best


@pytest.mark.parametrize("blocks", [1, 4, 6, 93])
@pytest.mark.parametrize("most_tasks", [1, 7, 1000])
def test_no_cell_grows_with_the_vectors(blocks, most_tasks):
    uneven = {task: 5 + task % 4 for task in range(3000)} | {17: 500}
    held = Counter(neighbours.column(task, n, blocks, most_tasks) for task, many in uneven.items() for n in range(many))
    assert max(held.values()) <= blocks
    share = min(blocks, neighbours.TASK_BLOCKS + 2)
    groups = -(-3000 // max(1, min(most_tasks, blocks // share)))
    assert len(held) <= groups * -(-8 // share) + -(-500 // share)


def test_few_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 2.0])], "vec_id long, embedding array<double>")
    found = neighbours.nearest(few, F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, found)) == [(0, 1, 1, 0.5), (0, 2, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 0, 0.0)]
    assert neighbours.nearest(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.nearest(few, F.lit(False)).count() == 0


def test_pipeline(spark, tmp_path):
    draw = random.Random(5)
    data = [(i, prose(draw, 60), "en", f"src{i % 3}", 0) for i in range(150)]
    toxic = {i for i in range(0, 150, 5)}
    data = [(i, t.replace(" ", " snorvik ", 1) if i in toxic else t, *rest) for i, t, *rest in data]
    long_text = prose(draw, 200)
    data += [(500, long_text, "en", "src0", 0), (501, long_text, "en", "src1", 0), (502, "write to a@b.cd " + prose(draw, 30), "en", "src2", 0)]
    frame(spark, data).drop("size", "start", "tokens", "spans", "root", "part", "score", "toxicity", "count", "block").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near duplicates", "personal data", "mixing", "packing"]
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, str(tmp_path))
        if at < 4:
            assert made.columns == docs.columns
        made.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = [r["doc_id"] for r in docs.collect()]
    clean = set(seen["toxicity"])
    assert not clean & toxic and len({i for i, *_ in data} - toxic - clean) <= 2
    assert sorted(seen["near duplicates"]) == sorted(clean - {501}) == sorted(seen["personal data"])
    private = spark.read.parquet(str(tmp_path / "personal data")).filter("doc_id = 502").collect()[0]
    assert private["text"].startswith("write to [EMAIL] ") and private["n_chars"] == len(private["text"])
    assert max(Counter(seen["mixing"]).values()) <= 3 and set(seen["mixing"]) <= clean - {501}
    assert set(seen["packing"]) == set(seen["mixing"])
    per_document = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("of")).collect()
    times = Counter(seen["mixing"])
    assert all(r["n"] == times[r["doc_id"]] * r["of"] for r in per_document)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    columns = ["doc_id", "start", "length", "doc_tokens"]
    # which pieces a window gets depends on the files; how much of each document there is does not
    assert whole.groupBy("doc_id").agg(F.sum("length")).collect().sort() == docs.groupBy("doc_id").agg(F.sum("length")).collect().sort()
    assert set(columns) <= set(whole.columns) and math.isclose(whole.agg(F.sum("length")).collect()[0][0], sum(r["n"] for r in per_document))
