import hashlib
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from __spark_entry__ import oracle_sql, queries
from barvault.llm import decontaminate, mixing, quality, registered, sharding, simhash
from barvault.llm.support import uniform
from tests.llm.helpers import AWKWARD, SF_DIR, documents, needs_tables, random_texts, with_clashes
from tests.llm.test_decontaminate import plain as plain_hits
from tests.llm.test_simhash import plain_fingerprint, plain_groups


@pytest.fixture
def tables(spark, tmp_path):
    """A folder with labels and benchmark for small documents."""
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)], "doc_id bigint, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet")
    )
    spark.createDataFrame([(1, "gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "one two three")], "item_id int, text string").write.parquet(
        str(tmp_path / "benchmark.parquet")
    )
    return str(tmp_path)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_on_awkward_rows(spark, tables):
    docs = with_clashes(documents(spark, [*AWKWARD, *((i, t) for i, t in enumerate(random_texts(4, 60), 20))]))
    for _, stage in pipeline.STAGES[:-1]:
        before = rows_of(docs)
        after = stage(spark, docs, tables)
        assert after.columns == docs.columns and {str(r) for r in rows_of(after)} <= {str(r) for r in before}
        docs = spark.createDataFrame(after.collect(), after.schema)
    last = pipeline.STAGES[-1][1](spark, docs, tables)
    assert last.count() == docs.count() and "shard" in last.columns


def test_stages_on_an_empty_table(spark, tables):
    docs = documents(spark, [])
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, tables).count() == 0


def test_one_of_each_group_stays(spark, tables):
    rows = [*AWKWARD[:5], *((i, t) for i, t in enumerate(random_texts(6, 100), 20))]
    kept = pipeline.keep_one_of_group(spark, documents(spark, rows), tables).collect()
    groups = plain_groups([k for k, _ in rows], [plain_fingerprint(t) for _, t in rows], simhash.DISTANCE)
    assert sorted(r["doc_id"] for r in kept) == sorted(set(groups))


def test_contaminated_documents_go(spark, tables):
    rows = [*AWKWARD, (30, "say one two three go"), (31, "one two and three")]
    kept = pipeline.drop_contaminated(spark, documents(spark, rows), tables).collect()
    items = [tuple(r) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    clean = [r[0] for r in plain_hits(rows, items, decontaminate.SPAN) if r[2] == 0]
    assert sorted((r["doc_id"] for r in kept), key=str) == sorted(clean, key=str)


def test_mix_repeats_documents(spark, tables):
    rows = [(i, "a b c d", "s0") for i in range(10)] + [(100, "x " * 40, "s1"), (100, "x " * 40, "s1"), (101, "", "s1")]
    mixed = pipeline.mix(spark, documents(spark, rows), tables).collect()
    # 120 words; s0 takes 120 * 5 / 7, s1 the rest
    assert abs(sum(4 for r in mixed if r["source"] == "s0") - 120 * 5 / 7) < 4
    assert len([r for r in mixed if r["doc_id"] == 100]) == 0 or all(r["text"] for r in mixed)


def test_some_of_equal_rows(spark):
    docs = documents(spark, [(1, "a")] * 5 + [(2, "b")] * 2 + [(3, "c")])
    from barvault.llm.support import row_key

    ids = docs.select(row_key(*docs.columns).alias("row_id"), "doc_id").distinct()
    wanted = {1: (5, 3), 2: (2, 5), 3: (1, 0)}
    table = spark.createDataFrame([(k, *v) for k, v in wanted.items()], "doc_id bigint, rows bigint, copies bigint")
    kept = pipeline._apply(docs, ids.join(table, "doc_id").drop("doc_id")).collect()
    assert sorted(r["doc_id"] for r in kept) == [1] * 3 + [2] * 5


#: ids from 0, copies with ids of their own, junk, two sources, and equal rows
SMALL = [
    (i, t + (" junk !!" * 200 if i % 10 == 3 else "") + (" one two three" if i % 11 == 5 else ""), f"s{i % 2}")
    for i, t in enumerate(random_texts(8, 90, 60))
]
SMALL += SMALL[10:14] * 2


def plain_good(spark, rows, good):
    """Rows that importance resampling selects, by loops; only the seeded noise is Spark's."""
    each = [np.concatenate([*quality.features(r[1].encode()), np.empty(0, int)]).astype(int) for r in rows]
    raw, target = np.ones(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for row, found in zip(rows, each, strict=True):
        for bucket in found:
            raw[bucket] += 1
            target[bucket] += row[0] in good
    raw /= raw.sum()

    def weight(found, target):
        ratios = np.log((target / target.sum() + quality.PRIOR * raw) / (1 + quality.PRIOR) / raw)
        return sum(ratios[found]) * min(1, 2 * quality.WORDS / max(len(found), 1))

    weights = [weight(found, target) for found in each]
    unseen = {}
    for row, found in zip(rows, each, strict=True):
        if row[0] in good:
            others = weight(found, target - np.bincount(found, minlength=quality.BUCKETS))
            unseen[row[0]] = min(others, unseen.get(row[0], others))
    cut = np.quantile(list(unseen.values()), quality.LOW) - quality.MARGIN
    draws = documents(spark, rows).select("doc_id", "text", uniform(quality.SEED, "doc_id", "text").alias("u")).collect()
    noise = {(r["doc_id"], r["text"]): -np.log(-np.log(r["u"])) for r in draws}
    ranked = sorted(range(len(rows)), key=lambda i: (-weights[i] - noise[rows[i][:2]], rows[i][0]))
    return [rows[i] for i in ranked[: sum(w >= cut for w in weights)]]


def plain_mix(spark, rows):
    """Rows as often as the mix takes them: whole copies of ``taken`` words."""
    taken = mixing.mix_sources(documents(spark, rows)).where("taken > 0").collect()
    copies = Counter()
    for r in taken:
        copies[r["key"]] += r["taken"] // r["size"]
    return [k for k, n in copies.items() for _ in range(n)]


def plain_shard(key):
    filled = sharding.fill(sharding.shard_names())
    return int(filled[int(hashlib.md5(str(key).encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE])


def ids_of(df):
    return Counter(r["doc_id"] for r in df.collect())


def test_good_rows_are_those_of_plain_loops(spark, tables):
    wanted = plain_good(spark, SMALL, set(range(0, 60, 2)))
    assert 0 < len(wanted) < len(SMALL)
    kept = pipeline.keep_good(spark, documents(spark, SMALL), tables).collect()
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in kept) == Counter(wanted)


def test_copies_of_the_mix(spark, tables):
    mixed = ids_of(pipeline.mix(spark, documents(spark, SMALL), tables))
    assert mixed == Counter(plain_mix(spark, SMALL)) and max(mixed.values()) > 1


def test_shards_are_those_of_the_filled_table(spark, tables):
    docs = documents(spark, SMALL)
    got = Counter((r["doc_id"], r["shard"]) for r in pipeline.shard(spark, docs, tables).collect())
    assert got == Counter((r[0], plain_shard(r[0])) for r in SMALL)


def test_run_is_the_plain_chain(spark, tables):
    documents(spark, SMALL).write.parquet(f"{tables}/documents.parquet")
    rows = plain_good(spark, SMALL, set(range(0, 60, 2)))
    rows = sorted(rows)
    groups = plain_groups([r[0] for r in rows], [plain_fingerprint(r[1]) for r in rows], simhash.DISTANCE)
    rows = list({r[0]: r for r in rows if r[0] in set(groups)}.values())
    items = [tuple(r) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    clean = {r[0] for r in plain_hits([r[:2] for r in rows], items, decontaminate.SPAN) if r[2] == 0}
    rows = [r for r in rows if r[0] in clean]
    wanted = Counter((k, plain_shard(k)) for k in plain_mix(spark, rows))
    assert wanted and wanted == Counter((r["doc_id"], r["shard"]) for r in pipeline.run(spark, tables).collect())


def test_names():
    found = queries()
    assert all(sum(name.startswith(f"op{n}_") for name in found) == 1 for n in range(1, 11)) and "pipeline" in found
    assert [len(s) for s in pipeline.STAGES] == [2] * 5


@needs_tables
def test_run(spark):
    out = pipeline.run(spark, SF_DIR)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert out.columns == [*docs.columns, "shard"] and 0 < out.count() <= 3 * docs.count()


@needs_tables
@pytest.mark.parametrize("name", sorted(n for n in oracle_sql() if n in registered.REGISTERED))
def test_equals_sql(spark, name):
    import duckdb

    from tools.check_oracle import SAME_TYPE, TABLES, rows_of as sorted_rows

    db = duckdb.connect()
    for table in TABLES:
        if os.path.exists(f"{SF_DIR}/{table}.parquet"):
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    df = queries()[name](spark, SF_DIR)
    found = db.execute(oracle_sql()[name])
    names = [d[0] for d in found.description]
    types = {d[0]: str(d[1]).replace(" ", "") for d in found.description}
    assert sorted(df.columns) == sorted(names)
    assert {c: SAME_TYPE.get(t, t.upper()) for c, t in df.dtypes} == types
    rows = sorted_rows(df.collect(), df.columns)
    assert rows and rows == sorted_rows(found.fetchall(), names)


@needs_tables
@pytest.mark.parametrize("stage", [stage for _, stage in pipeline.STAGES])
def test_stages_take_dotted_names_and_maps(spark, stage):
    rows = [(i, f"{text} {i}") for i, text in enumerate(random_texts(12, 12))] + [(3, "twice here"), (3, "twice here")]
    docs = documents(spark, rows).withColumns(
        {"a.b": F.col("doc_id") + 1, "facts": F.create_map(F.lit("k"), F.col("source")), "deep": F.struct(F.create_map(F.lit(1), F.col("text")).alias("m.n"))}
    )
    out = stage(spark, docs, SF_DIR)
    assert out.columns[: len(docs.columns)] == docs.columns
    kept = out.select("doc_id", "text", F.col("`a.b`").alias("ab"), "facts").collect()
    assert kept and {(r.doc_id, r.text) for r in kept} <= set(rows)
    assert all(r.ab == r.doc_id + 1 and r.facts == {"k": "src"} for r in kept)
