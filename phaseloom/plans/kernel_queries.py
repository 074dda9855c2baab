"""Queries for kernels, generators, the atlas build, experiments and streaming."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phaseloom.functions import draws
from phaseloom.functions.ball import rounded
from phaseloom.operators import charts, graph, kernels, ledger, proposals
from phaseloom.plans import atlas, corpora, publish, table_queries
from phaseloom.plans import experiments as X
from phaseloom.plans import sqltwin as S
from phaseloom.plans.shared import cut, scratch, table
from phaseloom.sources import adapters
from phaseloom.streaming import ledger_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


_IDS = f"WITH {S.LEDGER}, ids AS (SELECT src AS id FROM ledger UNION SELECT dst FROM ledger)"


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.ledger(spark, sf_dir)
    return e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()


@query(f"{_IDS} SELECT id, list_reduce(list_transform(string_split(id, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296, CAST(2166136261 AS BIGINT)) AS hash FROM ids")
def h10_fnv1a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(spark, sf_dir).select("id", draws.fnv1a(F.col("id")).alias("hash"))


_FNV = "list_reduce(list_transform(string_split(%s, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda h, c: (xor(h, c) * 16777619) %% 4294967296, CAST(2166136261 AS BIGINT))"
_HASHED = _IDS + f", hashed AS (SELECT id, {_FNV % 'id'} AS hash FROM ids)"


@query(f"{_HASHED} SELECT id, {', '.join(f'{S.draw('hash', str(k))} AS d{k}' for k in (1, 2, 3))} FROM hashed")
def h11_mulberry32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three draws for each node's hash as seed."""
    return h10_fnv1a(spark, sf_dir).select("id", *(draws.draw(F.col("hash"), F.lit(k)).alias(f"d{k}") for k in (1, 2, 3)))


_DEVIATES = ", ".join(f"sqrt(-2 * ln(greatest(1e-12, {S.draw('hash', str(2 * i - 1))}))) * cos(2 * {S.PI} * {S.draw('hash', str(2 * i))}) AS n{i}" for i in (1, 2, 3))


@query(f"{_HASHED}, n AS (SELECT id, {_DEVIATES} FROM hashed) SELECT id, {', '.join(S.r(f'n{i} / sqrt(n1 * n1 + n2 * n2 + n3 * n3)', 7) + f' AS x{i}' for i in (1, 2, 3))} FROM n")
def h12_hash_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _ids(spark, sf_dir).select("id", draws.hash_direction(F.col("id"), 3).alias("v"))
    return d.select("id", *(rounded(F.col("v")[i - 1], 7).alias(f"x{i}") for i in (1, 2, 3)))


@query(r"SELECT event_id, 'k' AS path, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS number FROM events")
def h13_numeric_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("array<struct<path:string,number:double>>")
    def leaves(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [{"path": p, "number": n} for p, n in kernels.numeric_leaves(json.loads(x))] if x else [])

    return table(spark, sf_dir, "events").select("event_id", F.explode(leaves("props")).alias("l")).select("event_id", "l.path", "l.number")


@query()
def h15_rip_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("array<double>")
    def vector(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [kernels.round_to(v, 9) for v in kernels.feature_vector(json.loads(x) if x else None)])

    return table(spark, sf_dir, "events").select("event_id", vector("props").alias("vector"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(ledger.fold_events(adapters.ledger(spark, sf_dir)))


@query()
def h20_hyper_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atlas.fit_ball(_edges(spark, sf_dir))


@query()
def d2_temporal_hyper_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fit of the first part of the ledger, carried on with all of it."""
    e = adapters.ledger(spark, sf_dir)
    train, _, _ = ledger.split_events(e, 0.5)
    prior = cut(atlas.fit_ball(cut(ledger.fold_events(train))))
    return atlas.fit_ball(_edges(spark, sf_dir), prior=prior)


def _rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame(rows))


_CORPUS = f"""
WITH plan AS (SELECT i AS ord, i // 6 AS chain, i % 6 AS place FROM range(36) AS a(i)),
named AS (SELECT ord, 'n' || chain || '_' || place AS id, 't' || (place % 4) AS topic FROM plan),
hashed AS (SELECT *, {_FNV % "'topic:' || topic"} AS hash FROM named)"""
_EIGHT = range(1, 9)
_DRAWN = ", ".join(f"{S.draw('hash', str(j))} * {S.TURN} AS h{j}, ({S.draw('1', f'(ord * 8 + {j})')} - 0.5) * 2 * 0.25 AS u{j}" for j in _EIGHT)


@query(f"{_CORPUS}, drawn AS (SELECT ord, id, topic, {_DRAWN} FROM hashed), moved AS (SELECT ord, id, topic, {', '.join(f'{S.turn(f"h{j}")} + u{j} AS m{j}' for j in _EIGHT)} FROM drawn) SELECT ord, id, topic, {', '.join(f'{S.r(S.turn(f"m{j}"), 9)} AS p{j}' for j in _EIGHT)} FROM moved")
def n1_n2_synthetic_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpora.corpus_nodes(spark)
    return c.select("ord", "id", "topic", *(rounded(F.col("phases")[j - 1], 9).alias(f"p{j}") for j in range(1, 9)))


_ORDERED = f"WITH {S.CHART_GRAPH}, {S.DISTINCT}, ranked AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS rank FROM nodes), total AS (SELECT count(*) AS n FROM nodes)"
_TRY = lambda k: f"CAST(floor({S.draw('7', k)} * n) AS BIGINT)"


@query(f"{_ORDERED}, tries AS (SELECT t, {_TRY('(2 * t + 1)')} AS i, {_TRY('(2 * t + 2)')} AS j FROM range(20000) AS a(t), total), "
       "tried AS (SELECT t, x.id AS a, y.id AS b, row_number() OVER (PARTITION BY least(i, j), greatest(i, j) ORDER BY t) AS again FROM tries JOIN ranked x ON x.rank = i JOIN ranked y ON y.rank = j WHERE i <> j AND NOT EXISTS (SELECT 1 FROM near WHERE u = x.id AND v = y.id)) "
       "SELECT a, b, CAST(row_number() OVER (ORDER BY t) - 1 AS INTEGER) AS place FROM tried WHERE again = 1 QUALIFY place < 8")
def n5_random_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.chart_graph(spark, sf_dir)
    return proposals.random_bridges(graph.node_set(e), e, 8)


@query()
def n8_run_arms_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = X.fit("ring")
    return _rows(spark, X.run_arms(f, X._makers(f, 3)))


def _sampled(seed: int, count: int) -> str:
    """CTEs that draw places for every row of own (source, out: ranks left out, rising; free:
    how many are left) one by one, and name them: drawn (source, place, other)."""
    past = lambda taken, x: f"list_reduce(list_sort({taken}), lambda p, t: CASE WHEN p >= t THEN p + 1 ELSE p END, CAST({x} AS BIGINT))"
    ctes = [f"s0 AS (SELECT own.*, (hash + {seed}) % 4294967296 AS start, CAST([] AS BIGINT[]) AS got FROM own JOIN hashed ON hashed.id = own.source)"]
    for k in range(1, count + 1):
        place = f"floor({S.draw('start', str(k))} * (free - {k - 1}))"
        ctes.append(f"s{k} AS (SELECT source, out, free, start, CASE WHEN {k} > free THEN got ELSE list_append(got, {past('got', place)}) END AS got FROM s{k - 1})")
    ctes.append(f"long AS (SELECT source, out, unnest(got) AS p, unnest(range(len(got))) AS place FROM s{count})")
    ctes.append(f"placed AS (SELECT source, CAST(place AS INTEGER) AS place, {past('out', 'p')} AS rank FROM long)")
    return ", ".join([*ctes, "drawn AS (SELECT source, place, ranked.id AS other FROM placed JOIN ranked USING (rank))"])


_HASHES = f", hashed AS (SELECT id, {_FNV % 'id'} AS hash FROM nodes)"


@query(f"{_ORDERED}{_HASHES}, gone AS (SELECT id AS source, rank FROM ranked UNION SELECT near.u, r.rank FROM near JOIN ranked r ON r.id = near.v), own AS (SELECT source, list_sort(list(rank)) AS out, any_value(n) - count(*) AS free FROM gone, total GROUP BY source), {_sampled(7, 3)} SELECT source AS a, other AS b, place FROM drawn")
def n9_random_query_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.chart_graph(spark, sf_dir)
    ids = graph.node_set(e)
    return proposals.random_query_bridges(ids.withColumnRenamed("id", "source"), ids, e, 3)


@query(f"{_IDS}, nodes AS (SELECT id FROM ids), ranked AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS rank FROM nodes), total AS (SELECT count(*) AS n FROM nodes){_HASHES}, own AS (SELECT id AS source, [rank] AS out, n - 1 AS free FROM ranked, total), {_sampled(5, 6)} SELECT source, place, other FROM drawn")
def o5_random_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six seeded proposals for every node, out of all others."""
    ids = _ids(spark, sf_dir)
    return proposals.random_proposals(ids.withColumnRenamed("id", "source"), ids, 6)


_PLANTED = """
WITH inside AS (
    SELECT c, k, i, 0 AS beside, 'derived' AS kind, 't' || k || '_' || i AS src, 't' || (k + 1) || '_' || i AS dst, c * 100 + floor(k * 100 / 4.0 + 0.5) + i AS ts FROM range(12) a(c), range(3) b(k), range(6) d(i)
    UNION ALL
    SELECT c, 0, i, 1, 'assoc', 't0_' || (i - 1), 't0_' || i, c * 100 + i FROM range(12) a(c), range(1, 6) d(i)),
numbered AS (SELECT row_number() OVER (ORDER BY c, k, i, beside) - 1 AS seq, kind, src, dst, ts FROM inside),
after AS (SELECT (SELECT count(*) FROM inside) + k * 4 + j AS seq, 'assoc' AS kind, 't' || k || '_' || (j % 6) AS src, 't' || k || '_' || ((j + 2) % 6) AS dst, 1210 + j AS ts FROM range(4) a(k), range(4) b(j))
SELECT seq, kind, src, dst, 1.0::DOUBLE AS weight, CAST(ts AS DOUBLE) AS ts FROM (SELECT * FROM numbered UNION ALL SELECT * FROM after)"""


@query(_PLANTED)
def n11_synthetic_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.ledger(spark)


@query()
def o4_phase_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    tori = {r["id"]: list(r["torus"]) for r in adapters.charts(spark, sf_dir).orderBy("id").limit(200).collect()}
    return _rows(spark, [X.phase_signal(tori)])


@query()
def c1_build_atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = atlas.build_atlas(adapters.ledger(spark, sf_dir))
    return a.ball.join(a.torus.select("id", "torus", "placed"), "id")


@query()
def c2_c3_canonical_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("string")
    def digest(s: pd.Series) -> pd.Series:
        return s.map(lambda x: kernels.content_hash(kernels.canonical_json(json.loads(x) if x else None)))

    return table(spark, sf_dir, "events").select("event_id", digest("props").alias("hash"))


@query()
def c4_serialize_atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = atlas.build_atlas(adapters.ledger(spark, sf_dir))
    with tempfile.TemporaryFile() as spool:
        digest = atlas.serialized(built, "v1", 0, spool)
    return spark.createDataFrame([("v1", digest, built.nodes.count(), built.edges.count())], "version string, hash string, nodes int, edges int")


_FOLD = S.LEDGER + f""",
sound AS (SELECT *, greatest(0.0, coalesce(weight, 1)) AS w FROM ledger WHERE src <> dst),
placed AS (SELECT *, row_number() OVER (PARTITION BY src, dst, kind ORDER BY ts, seq) - 1 AS n FROM sound)"""


@query(f"WITH {_FOLD} SELECT src, dst, kind, {S.r(f'least(5.0, sum(w * power({S.PHI}, -n)))', 6)} AS weight FROM placed GROUP BY src, dst, kind")
def a1_sync_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger landed as files, streamed in and folded per micro-batch."""
    base = scratch(spark, "ingest")
    adapters.ledger(spark, sf_dir).repartition(4, "seq").write.parquet(f"{base}/landing")
    stream = spark.readStream.schema(ledger_stream.LEDGER).option("maxFilesPerTrigger", 2).parquet(f"{base}/landing")
    ledger_stream.ingest(stream, f"{base}/ledger", f"{base}/edges", f"{base}/progress").awaitTermination()
    return ledger_stream.current_edges(spark, f"{base}/edges").select("src", "dst", "kind", rounded(F.col("weight"), 6).alias("weight"))


@query()
def a2_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two builds of the ledger, the first of its earlier part, the second warm: exit code, hash and size."""
    base, events = scratch(spark, "publish"), adapters.ledger(spark, sf_dir)
    train, _, _ = ledger.split_events(events, 0.5)
    rows = [(code, doc["version"], doc["hash"], doc.sizes["edges"]) for code, doc in (publish.publish(spark, train, base, 1), publish.publish(spark, events, base, 2))]
    return spark.createDataFrame(rows, "code int, version string, hash string, edges int")


@query()
def a3_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, X.bench())


@query()
def a3_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, X.ablation(spark))


@query()
def a4_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, X.hybrid())


@query()
def a6_crossover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, X.crossover())


@query()
def a7_a8_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The holdout of the ledger: its arms and the verdict."""
    signal, arms, word = atlas.holdout(adapters.ledger(spark, sf_dir))
    return _rows(spark, [a | {"verdict": word, "degenerate": signal["degenerate"]} for a in arms])


_SIX = S.r("p", 6)
_NEAREST = table_queries._PROBE + f""",
sixth AS (SELECT id, k, {_SIX} AS p FROM phase),
user_phase AS (SELECT id, {', '.join(f'{S.turn(f"max(CASE WHEN k = {k} THEN p END)")} AS t{k + 1}' for k in range(8))} FROM sixth WHERE id LIKE 'u%' GROUP BY id HAVING bool_or(p <> 0)),
d AS (SELECT x.id AS a, y.id AS b, {S.r(S.torus_distance(S.vec('x.t', 8), S.vec('y.t', 8), True), 5)} AS dist FROM user_phase x JOIN user_phase y ON y.id <> x.id WHERE CAST(substr(x.id, 2) AS BIGINT) % 100 = 0)"""


@query(f"WITH {_NEAREST} SELECT a, b, dist, CAST(row_number() OVER (PARTITION BY a ORDER BY dist, b) AS INTEGER) AS place FROM d QUALIFY place <= 5")
def flagship_torus_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)


def flagship(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """The nearest users by activity phase: a, b, place, dist.  Asked for are the users whose
    number is divisible by 100, and all users are compared with them."""
    from phaseloom.functions import torus as T

    p = ledger.node_phases(adapters.ledger(spark, sf_dir)).filter("id like 'u%'")
    p = cut(p.select("id", T.phases_to_torus(F.col("phases")).alias("torus")))
    asked = p.filter(F.substring("id", 2, 20).cast("long") % 100 == 0)
    return charts.nearest_by_phase(asked, p, k)
