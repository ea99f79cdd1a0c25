"""Queries of the research-front analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agreement as A
from ..operators import bins as B
from ..operators import community as C
from ..operators import coupling as L
from ..operators import density as Y
from ..operators import fastrp as P
from ..operators import matching as M
from ..operators import terms as T
from ..operators import tracking as K
from ..operators import vectors as V
from ..sources.readers import table, year_range
from .stages import Run
from .works import SQL, bare_works, work_institutions, work_references, works

DIM = 128


def year_histogram(spark, d):
    return B.histogram(works(spark, d))


def temporal_bins(spark, d):
    return B.equal_volume(works(spark, d), 5)


def sliding_windows(spark, d):
    return B.sliding(year_range(works(spark, d)))


def bin_assign(spark, d):
    w = works(spark, d)
    return B.assign(w.select("id", "year"), B.sliding(year_range(w))).groupBy("bin_id").agg(F.count("*").cast("long").alias("n"))


def bin_assign_first(spark, d):
    w = works(spark, d)
    return B.assign(w.select("id", "year"), B.equal_volume(w.filter("year < 2000"), 4), last=False).groupBy("bin_id").agg(F.count("*").cast("long").alias("n"))


def citation_pairs_open(spark, d):
    return L.open_links(work_references(spark, d)).groupBy("source").agg(F.count("*").cast("long").alias("n_refs"))


def citation_pairs_closed(spark, d):
    return L.closed_links(work_references(spark, d), works(spark, d).filter("year between 1996 and 1998"))


def _dated_refs(spark, d):
    return work_references(spark, d).join(bare_works(spark, d).select("id", "year"), "id")


def coupling(spark, d):
    return L.coupled(_dated_refs(spark, d), "year")


def salton_edges(spark, d):
    refs = _dated_refs(spark, d)
    return L.salton(L.coupled(refs, "year", sized=True), refs, "year").select("year", "a", "b", F.round("weight", 6).alias("weight"))


def _hetero(spark, d):
    w = bare_works(spark, d).select("id", "source_id")
    links = L.closed_links(work_references(spark, d).join(w.select("id"), "id"), w)
    inst = work_institutions(spark, d).join(w.select("id"), "id").select("id", F.col("inst").alias("member"))
    return L.heterogeneous(links, institution=inst, source=w.select("id", F.col("source_id").alias("member")))


def hetero_edges(spark, d):
    return _hetero(spark, d)


def degree(spark, d):
    return L.degrees(_hetero(spark, d))


def fastrp(spark, d):
    found = P.fastrp(_hetero(spark, d), DIM, asked=F.col("node").startswith("W"))
    return found.select("node", F.posexplode("v").alias("dim", "x")).select("node", F.col("dim").cast("long").alias("dim"), (F.round("x", 5) + 0.0).alias("x"))


def vector_norm(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.size("embedding").cast("long").alias("dims"))


def vector_cosine_topk(spark, d):
    rows = table(spark, d, "embeddings")
    return V.nearest(rows, rows.filter("vec_id % 20 = 0")).select("query", "neighbour", F.round("cosine", 6).alias("cosine"), "rank")


def _store(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.lit(2015) + F.col("vec_id") % 9).cast("int").alias("year"), F.when(F.col("label") != 3, F.col("embedding")).alias("model_a"), F.when(F.col("label") < 2, F.col("embedding")).otherwise(F.array().cast("array<float>")).alias("model_b"))


def vector_coverage(spark, d):
    return V.coverage(_store(spark, d), {"a": "model_a", "b": "model_b"})


def vector_missing(spark, d):
    known = _store(spark, d).filter(F.size("model_b") > 0)
    return M.missing(table(spark, d, "documents").select(F.col("doc_id").alias("id")), "id", known)


def vector_window(spark, d):
    return V.window(_store(spark, d), 2016, 2018, "model_a").select("id", F.size("model_a").cast("long").alias("dims"))


def projected_sign(spark, d):
    """The coordinates of a random projection to four dimensions, and their signs."""
    found = V.projected(table(spark, d, "embeddings"), "embedding", 64, 4).select("vec_id", F.posexplode("projected").alias("dim", "x"))
    return found.select("vec_id", F.col("dim").cast("long").alias("dim"), (F.round("x", 5) + 0.0).alias("x"), (F.col("x") > 1e-9).alias("positive"))


def embedding_text(spark, d):
    rows = table(spark, d, "documents")
    return rows.select("doc_id", F.md5(V.template(F.substring("text", 1, 20), F.col("text"))).alias("digest"))


def _parts(spark, d):
    sign = lambda i: F.when(F.element_at("embedding", i) > 0, 1).otherwise(0)
    return table(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 50 != 0, F.col("label")).otherwise(-1).alias("a"), (sign(1) * 4 + sign(2) * 2 + sign(3)).alias("b"))


def contingency(spark, d):
    return A.contingency(_parts(spark, d), "a", "b")


def mutual_information(spark, d):
    return A.mutual_information(_parts(spark, d), "a", "b").select("n", *[F.round(c, 6).alias(c) for c in ("mi", "h_a", "h_b")])


def ami(spark, d):
    return A.adjusted(_parts(spark, d), "a", "b").select(F.round("ami", 6).alias("ami"))


def _weekly(spark, d):
    rows = table(spark, d, "events")
    return rows.select(F.floor((F.dayofmonth("ts") - 1) / 7).cast("int").alias("bin_id"), F.col("event_type").alias("cluster"), F.col("user_id").alias("id"))


def cluster_transitions(spark, d):
    found = K.transitions(_weekly(spark, d).withColumn("cluster", F.col("id") % 3))
    return found.select("from_bin", "to_bin", F.col("from_cluster").cast("long").alias("from_cluster"), F.col("to_cluster").cast("long").alias("to_cluster"), F.round("jaccard", 6).alias("jaccard"), "shared_docs")


def event_transitions(spark, d):
    typed = _weekly(spark, d).withColumn("cluster", F.ascii("cluster"))
    found = K.transitions(typed, least=0.3)
    return found.select("from_bin", "to_bin", "from_cluster", "to_cluster", F.round("jaccard", 6).alias("jaccard"), "shared_docs")


def sankey_index(spark, d):
    return K.sankey(event_transitions(spark, d))


def cluster_sizes(spark, d):
    return K.sizes(_weekly(spark, d))


def small_bin_rule(spark, d):
    rows = works(spark, d).select("id", F.col("source_id").alias("bin_id"), (F.col("id") % 4).cast("int").alias("cluster"))
    return K.small_bins(rows, "cluster", least=12).groupBy("cluster").agg(F.count("*").cast("long").alias("n"))


def multi_partition_merge(spark, d):
    rows = table(spark, d, "embeddings")
    frames = {"a": rows.select(F.col("vec_id").alias("id"), F.col("label").alias("a")), "b": rows.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("id"), (F.col("label") + 1).alias("b")), "c": rows.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 7).alias("c"))}
    return M.merged(frames, "id")


def cluster_terms(spark, d):
    return T.cluster_terms(table(spark, d, "documents").withColumnRenamed("doc_id", "id"), "lang")


def cluster_labels(spark, d):
    return T.labels(cluster_terms(spark, d), "lang")


def top_titles(spark, d):
    rows = works(spark, d).select("id", "topic", F.concat(F.lit("Work "), F.col("id").cast("string")).alias("title"), F.round("price", 2).alias("cited"))
    return T.top_titles(rows, "topic", "title", "cited", "id")


def communities(spark, d):
    refs = _dated_refs(spark, d)
    nodes = works(spark, d).select("year", "id")
    edges = L.salton(L.coupled(refs, "year", sized=True), refs, "year")
    return C.detect(nodes, edges, "year")


def density_clusters(spark, d):
    rows = table(spark, d, "embeddings").select(F.lit(0).alias("bin_id"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return Y.detect(rows, "bin_id", least=15, neighbours=5)


def _partition(meta: DataFrame, found: DataFrame) -> DataFrame:
    """A cluster for every work of a bin: null where the level has none for it, 0 in small bins."""
    return K.small_bins(meta.select("bin_id", "id").join(found, ["bin_id", "id"], "left"), "cluster")


def _structural(meta: DataFrame, refs: DataFrame) -> DataFrame:
    cited = refs.select("bin_id").distinct()
    found = C.detect(meta.join(cited, "bin_id", "left_semi"), L.salton(L.coupled(refs, "bin_id", sized=True), refs, "bin_id"), "bin_id")
    return _partition(meta, found.unionByName(C.without_edges(meta.join(cited, "bin_id", "left_anti").select("bin_id", "id"))))


def _semantic(meta: DataFrame, vectors: DataFrame) -> DataFrame:
    """``vectors``: id, embedding of 64 numbers."""
    rows = V.projected(meta.join(vectors, "id"), "embedding", 64, 30)
    return _partition(meta, Y.detect(rows, "bin_id", vector="projected"))


def _topological(meta: DataFrame, refs: DataFrame, institutions: DataFrame) -> DataFrame:
    """One graph of all bins, whose nodes carry their bin, so bins don't meet."""
    inside = refs.join(meta.select("bin_id", F.col("id").alias("ref")), ["bin_id", "ref"], "left_semi")
    name = lambda letter, c: F.concat(F.col("bin_id").cast("string"), F.lit(letter), F.col(c).cast("string"))
    ends = [(inside, "W", "ref"), (meta.select("bin_id", "id").join(institutions, "id"), "I", "inst"), (meta, "S", "source_id")]
    links = [rows.select(name("W", "id").alias("src"), name(letter, c).alias("dst")) for rows, letter, c in ends]
    found = P.fastrp(links[0].unionByName(links[1]).unionByName(links[2]), asked=F.col("node").contains("W"))
    part = F.split("node", "W")
    rows = found.select(part[0].cast("int").alias("bin_id"), part[1].cast("long").alias("id"), "v")
    return _partition(meta, Y.detect(rows, "bin_id"))


def _labels(structural: DataFrame, meta: DataFrame, texts: DataFrame) -> DataFrame:
    """bin_id, cluster, size, label, keywords of clusters of five works or more. ``texts``: id, text."""
    key = F.concat_ws("_", "bin_id", "cluster").alias("key")
    large = K.sizes(structural.filter(F.col("cluster") != K.NOISE)).filter("size >= 5").select("*", key)
    docs = structural.select("bin_id", "id", key).join(large.select("key"), "key").join(meta.select("bin_id", "id", "topic"), ["bin_id", "id"]).join(texts, "id", "left")
    named = T.labels(T.cluster_terms(docs.select("key", "id", F.concat_ws(" ", "topic", "text").alias("text")), "key", top=8), "key")
    return large.join(named, "key").drop("key")


def analysis(spark: SparkSession, d: str, root: str, force_from: str | None = None) -> tuple[Run, DataFrame]:
    """All levels over sliding windows, each a table under ``root``; vectors and texts are those with a work's id."""
    run = Run(spark, root, force_from)
    windows = run.level("windows", lambda: B.sliding(year_range(works(spark, d))))
    meta = run.level("metadata", lambda: B.members(works(spark, d).select("id", "year", "topic", "source_id"), windows).select("bin_id", "id", "year", "topic", "source_id"))
    refs = run.level("citations", lambda: work_references(spark, d).join(meta.select("bin_id", "id"), "id").select("bin_id", "id", "ref"))
    structural = run.level("structural", lambda: _structural(meta, refs))
    semantic = run.level("semantic", lambda: _semantic(meta, table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), "embedding")))
    topological = run.level("topological", lambda: _topological(meta, refs, work_institutions(spark, d)))
    levels = {"structural": structural, "semantic": semantic, "topological": topological}

    def agreement() -> DataFrame:
        both = M.merged({name: df.select(F.concat_ws("_", "bin_id", "id").alias("key"), F.col("cluster").alias(name)) for name, df in levels.items()}, "key")
        return A.pairwise(both, list(levels))

    run.level("agreement", agreement)
    run.level("tracking", lambda: K.transitions(structural))
    return run, run.level("labels", lambda: _labels(structural, meta, table(spark, d, "documents").select(F.col("doc_id").cast("long").alias("id"), "text")))


QUERIES = {f.__name__: f for f in (
    year_histogram, temporal_bins, sliding_windows, bin_assign, bin_assign_first, citation_pairs_open, citation_pairs_closed, coupling, salton_edges, hetero_edges, degree, fastrp, vector_norm,
    vector_cosine_topk, vector_coverage, vector_missing, vector_window, projected_sign, embedding_text, contingency, mutual_information, ami, cluster_transitions, event_transitions, sankey_index,
    cluster_sizes, small_bin_rule, multi_partition_merge, cluster_terms, cluster_labels, top_titles, communities, density_clusters,
)}

_W = f"WITH {SQL}"
_BINS = """, h AS (SELECT year, count(*) AS n FROM {0} GROUP BY year), u AS (SELECT year, sum(n) OVER (ORDER BY year) AS upto, sum(n) OVER () AS total FROM h),
c AS (SELECT DISTINCT min(year) AS cut FROM u, range(1, {1} + 1) t(j) WHERE upto > floor((total - 1) * j / {1}) GROUP BY j),
b AS (SELECT CAST(row_number() OVER (ORDER BY cut) - 1 AS INT) AS bin_id, CAST(coalesce(lag(cut) OVER (ORDER BY cut) + 1, (SELECT min(year) FROM h)) AS INT) AS y_start, CAST(cut AS INT) AS y_end FROM c)"""
_SLIDE = ", y AS (SELECT min(year) AS a, max(year) AS z FROM w), s AS (SELECT CAST(row_number() OVER (ORDER BY x) - 1 AS INT) AS bin_id, CAST(x AS INT) AS y_start, CAST(x + 2 AS INT) AS y_end FROM (SELECT unnest(range(a, z - 1)) AS x FROM y))"
_CPL = ", r AS (SELECT wr.*, year FROM wr JOIN w USING (id)), p AS (SELECT x.year, x.id AS a, y.id AS b, count(*) AS shared FROM r x JOIN r y ON x.year = y.year AND x.ref = y.ref AND x.id < y.id GROUP BY ALL)"
_HET = """, z AS (SELECT id, source_id FROM w),
e AS (SELECT 'W' || id AS src, 'W' || ref AS dst FROM wr WHERE id IN (SELECT id FROM z) AND ref IN (SELECT id FROM z)
      UNION ALL SELECT 'W' || id, 'I' || inst FROM wi WHERE id IN (SELECT id FROM z) UNION ALL SELECT 'W' || id, 'S' || source_id FROM z)"""
_PARTS = "p AS (SELECT vec_id, CASE WHEN vec_id % 50 <> 0 THEN label ELSE -1 END AS a, CAST(embedding[1] > 0 AS INT) * 4 + CAST(embedding[2] > 0 AS INT) * 2 + CAST(embedding[3] > 0 AS INT) AS b FROM embeddings), t AS (SELECT a, b, count(*) AS n FROM p WHERE a <> -1 AND b <> -1 GROUP BY ALL)"
_TRACK = """, q AS (SELECT DISTINCT bin_id, cluster, id FROM {0}), k AS (SELECT bin_id, cluster, count(*) AS size FROM q GROUP BY ALL),
nx AS (SELECT bin_id, lead(bin_id) OVER (ORDER BY bin_id) AS to_bin FROM (SELECT DISTINCT bin_id FROM q)),
m AS (SELECT x.bin_id AS from_bin, y.bin_id AS to_bin, x.cluster AS from_cluster, y.cluster AS to_cluster, count(*) AS shared_docs FROM q x JOIN nx ON nx.bin_id = x.bin_id JOIN q y ON y.bin_id = nx.to_bin AND y.id = x.id GROUP BY ALL),
j AS (SELECT m.*, shared_docs / (f.size + g.size - shared_docs) AS jaccard FROM m JOIN k f ON f.bin_id = from_bin AND f.cluster = from_cluster JOIN k g ON g.bin_id = to_bin AND g.cluster = to_cluster)"""
_WEEK = "ev AS (SELECT CAST(floor((day(ts) - 1) / 7) AS INT) AS bin_id, event_type AS cluster, user_id AS id FROM events)"
_STOP = ", ".join(f"'{x}'" for x in T.STOP_WORDS)
_FRP = _W + _HET + f""", bo AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), no AS (SELECT DISTINCT src AS node FROM bo), di AS (SELECT unnest(range(0, {DIM})) AS dim),
r0 AS (SELECT node, dim, CASE WHEN left(md5(node || ':' || dim), 1) < '8' THEN 1 ELSE -1 END * pow({DIM}.0, -0.5) AS x FROM no, di),
h1 AS (SELECT src AS node, r0.dim, avg(r0.x) AS m FROM bo JOIN r0 ON r0.node = bo.dst GROUP BY ALL), v1 AS (SELECT h1.node, h1.dim, m + x AS x FROM h1 JOIN r0 USING (node, dim)),
h2 AS (SELECT src AS node, v1.dim, avg(v1.x) AS m FROM bo JOIN v1 ON v1.node = bo.dst GROUP BY ALL), v2 AS (SELECT h2.node, h2.dim, m + x AS x FROM h2 JOIN r0 USING (node, dim)),
h3 AS (SELECT src AS node, v2.dim, avg(v2.x) AS m FROM bo JOIN v2 ON v2.node = bo.dst GROUP BY ALL), v3 AS (SELECT h3.node, h3.dim, m + x AS x FROM h3 JOIN r0 USING (node, dim)),
nr AS (SELECT node, sqrt(sum(x * x)) AS norm FROM v3 GROUP BY node)
SELECT node, dim, round(CASE WHEN norm > 0 THEN x / norm ELSE x END, 5) + 0.0 AS x FROM v3 JOIN nr USING (node) WHERE node LIKE 'W%'"""
_TERMS = f"""WITH t AS (SELECT doc_id AS k, lang, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 2 AND w NOT IN ({_STOP})) AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT k, lang, unnest(w) AS term FROM t UNION ALL SELECT k, lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM t),
tf AS (SELECT lang, k, term, count(*) AS tf FROM g GROUP BY ALL), tot AS (SELECT lang, term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY ALL),
vo AS (SELECT * FROM tot QUALIFY row_number() OVER (PARTITION BY lang ORDER BY total DESC, term) <= 1000), n AS (SELECT lang, count(*) AS n FROM t GROUP BY lang),
x AS (SELECT tf.lang, k, term, tf * (ln((1 + n) / (1 + df)) + 1) AS x FROM tf JOIN vo USING (lang, term) JOIN n USING (lang)), nm AS (SELECT lang, k, sqrt(sum(x * x)) AS norm FROM x GROUP BY ALL),
s AS (SELECT lang, term, round(sum(x / norm), 6) AS weight FROM x JOIN nm USING (lang, k) GROUP BY ALL),
o AS (SELECT lang, term, weight, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term) AS rank FROM s QUALIFY rank <= 10)"""
_STORE = "st AS (SELECT vec_id AS id, CAST(2015 + vec_id % 9 AS INT) AS year, CASE WHEN label <> 3 THEN embedding END AS model_a, CASE WHEN label < 2 THEN embedding ELSE [] END AS model_b FROM embeddings)"

ORACLES = {
    "year_histogram": _W + " SELECT year, count(*) AS n FROM w GROUP BY year",
    "temporal_bins": _W + _BINS.format("w", 5) + " SELECT * FROM b",
    "sliding_windows": _W + _SLIDE + " SELECT * FROM s",
    "bin_assign": _W + _SLIDE + ", a AS (SELECT id, coalesce(max(bin_id), -1) AS bin_id FROM w LEFT JOIN s ON year BETWEEN y_start AND y_end GROUP BY id) SELECT bin_id, count(*) AS n FROM a GROUP BY bin_id",
    "bin_assign_first": _W + _BINS.format("(SELECT * FROM w WHERE year < 2000)", 4) + ", a AS (SELECT id, coalesce(min(bin_id), -1) AS bin_id FROM w LEFT JOIN b ON year BETWEEN y_start AND y_end GROUP BY id) SELECT bin_id, count(*) AS n FROM a GROUP BY bin_id",
    "citation_pairs_open": _W + " SELECT id AS source, count(*) AS n_refs FROM wr GROUP BY id",
    "citation_pairs_closed": _W + " SELECT id AS source, ref AS target FROM wr WHERE ref IN (SELECT id FROM w WHERE year BETWEEN 1996 AND 1998)",
    "coupling": _W + _CPL + " SELECT * FROM p",
    "salton_edges": _W + _CPL + ", k AS (SELECT id, count(*) AS k FROM r GROUP BY id), e AS (SELECT year, a, b, shared / sqrt(x.k * y.k) AS weight FROM p JOIN k x ON x.id = a JOIN k y ON y.id = b) SELECT year, a, b, round(weight, 6) AS weight FROM e WHERE weight >= 0.1",
    "hetero_edges": _W + _HET + " SELECT * FROM e",
    "degree": _W + _HET + " SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node",
    "fastrp": _FRP,
    "vector_norm": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS norm, len(embedding) AS dims FROM embeddings",
    "vector_cosine_topk": "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (SELECT q.vec_id AS query, n.vec_id AS neighbour, list_cosine_similarity(q.v, n.v) AS cosine FROM e q JOIN e n ON q.vec_id <> n.vec_id WHERE q.vec_id % 20 = 0) SELECT query, neighbour, round(cosine, 6) AS cosine, row_number() OVER (PARTITION BY query ORDER BY round(cosine, 9) DESC, neighbour) AS rank FROM c QUALIFY rank <= 5",
    "vector_coverage": f"WITH {_STORE} SELECT count(*) AS total, count(*) FILTER (len(model_a) > 0) AS with_a, count(*) FILTER (len(model_b) > 0) AS with_b FROM st",
    "vector_missing": f"WITH {_STORE} SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT id FROM st WHERE len(model_b) > 0)",
    "vector_window": f"WITH {_STORE} SELECT id, len(model_a) AS dims FROM st WHERE year BETWEEN 2016 AND 2018 AND len(model_a) > 0",
    "projected_sign": "WITH g AS (SELECT i, list(CASE WHEN left(md5(i || ':' || j), 1) < '8' THEN 0.5 ELSE -0.5 END ORDER BY j) AS s FROM range(4) a(i), range(64) b(j) GROUP BY i), x AS (SELECT vec_id, i AS dim, list_dot_product(CAST(embedding AS DOUBLE[]), CAST(s AS DOUBLE[])) AS x FROM embeddings, g) SELECT vec_id, dim, round(x, 5) + 0.0 AS x, x > 1e-9 AS positive FROM x",
    "embedding_text": "SELECT doc_id, md5('Title: ' || left(text, 20) || ' [SEP] Abstract: ' || text) AS digest FROM documents",
    "contingency": f"WITH {_PARTS} SELECT * FROM t",
    "mutual_information": f"WITH {_PARTS}, x AS (SELECT *, sum(n) OVER () AS total, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb FROM t), ra AS (SELECT a, sum(n) AS m FROM t GROUP BY a), rb AS (SELECT b, sum(n) AS m FROM t GROUP BY b) SELECT CAST(max(total) AS BIGINT) AS n, round(sum(n / total * ln(n * total / (na * nb))), 6) AS mi, (SELECT round(-sum(m / s * ln(m / s)), 6) FROM ra, (SELECT sum(n) AS s FROM t)) AS h_a, (SELECT round(-sum(m / s * ln(m / s)), 6) FROM rb, (SELECT sum(n) AS s FROM t)) AS h_b FROM x",
    "ami": f"""WITH {_PARTS}, x AS (SELECT a, CAST(sum(n) AS BIGINT) AS m FROM t GROUP BY a), y AS (SELECT b, CAST(sum(n) AS BIGINT) AS m FROM t GROUP BY b), z AS (SELECT CAST(sum(n) AS BIGINT) AS n FROM t),
h AS (SELECT (SELECT -sum(m / z.n * ln(m / z.n)) FROM x, z) AS ha, (SELECT -sum(m / z.n * ln(m / z.n)) FROM y, z) AS hb, (SELECT sum(t.n / z.n * ln(t.n * z.n / (x.m * y.m))) FROM t JOIN x USING (a) JOIN y USING (b), z) AS mi),
k AS (SELECT x.m AS a, y.m AS b, z.n, unnest(range(greatest(1, x.m + y.m - z.n), least(x.m, y.m) + 1)) AS k FROM x, y, z),
e AS (SELECT sum(k / n * ln(n * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(n - a + 1) + lgamma(n - b + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(n - a - b + k + 1))) AS e FROM k)
SELECT round((mi - e) / ((ha + hb) / 2 - e), 6) AS ami FROM h, e""",
    "cluster_transitions": f"WITH {_WEEK}, ec AS (SELECT bin_id, id % 3 AS cluster, id FROM ev)" + _TRACK.format("ec") + " SELECT from_bin, to_bin, from_cluster, to_cluster, round(jaccard, 6) AS jaccard, shared_docs FROM j WHERE jaccard > 0.05",
    "event_transitions": f"WITH {_WEEK}, ec AS (SELECT bin_id, ascii(cluster) AS cluster, id FROM ev)" + _TRACK.format("ec") + " SELECT from_bin, to_bin, from_cluster, to_cluster, round(jaccard, 6) AS jaccard, shared_docs FROM j WHERE jaccard > 0.3",
    "sankey_index": f"WITH {_WEEK}, ec AS (SELECT bin_id, ascii(cluster) AS cluster, id FROM ev)" + _TRACK.format("ec") + ", l AS (SELECT 'B' || from_bin || '_C' || from_cluster AS source_label, 'B' || to_bin || '_C' || to_cluster AS target_label, shared_docs AS value FROM j WHERE jaccard > 0.3), nn AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS i FROM (SELECT source_label AS label FROM l UNION SELECT target_label FROM l)) SELECT x.i AS source, y.i AS target, value, source_label, target_label FROM l JOIN nn x ON x.label = source_label JOIN nn y ON y.label = target_label",
    "cluster_sizes": f"WITH {_WEEK} SELECT bin_id, cluster, count(*) AS size FROM ev GROUP BY ALL",
    "small_bin_rule": _W + ", x AS (SELECT CASE WHEN count(*) OVER (PARTITION BY source_id) < 12 THEN 0 ELSE CAST(id % 4 AS INT) END AS cluster FROM w) SELECT cluster, count(*) AS n FROM x GROUP BY cluster",
    "multi_partition_merge": "SELECT vec_id AS id, label AS a, CASE WHEN vec_id % 3 = 0 THEN label + 1 END AS b, CASE WHEN vec_id % 2 = 0 THEN vec_id % 7 END AS c FROM embeddings",
    "cluster_terms": _TERMS + " SELECT * FROM o",
    "cluster_labels": _TERMS + " SELECT lang, string_agg(term, ' / ' ORDER BY rank) FILTER (rank <= 3) AS label, string_agg(term, ', ' ORDER BY rank) AS keywords FROM o GROUP BY lang",
    "top_titles": _W + ", t AS (SELECT topic, id, 'Work ' || id AS title, round(price, 2) AS cited FROM w) SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY cited DESC, id) AS rank, id, title, cited FROM t QUALIFY rank <= 5",
}
