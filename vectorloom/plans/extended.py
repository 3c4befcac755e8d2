"""More queries over the driver's tables: whole runs, result tables, preparation from end to end, caches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..operators import metrics as M
from ..operators import preparation as P
from ..operators import quant as Q
from ..operators import reports as R
from ..operators import retrieval as X
from ..operators import statistics as S
from ..operators.storage import folder
from ..sources import datasets as D
from . import catalogue as C
from .catalogue import BASE, GRADES, HASHED, NORM, WORDS, query, table

RUN = BASE + """, judged_q AS (SELECT DISTINCT query_id FROM j),
n AS (SELECT query_id, grade, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM r JOIN j USING (query_id, doc_id) WHERE rank <= 100),
bi AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS i FROM j),
b AS (SELECT query_id, count(*) AS n_rel, sum(grade / log2(i + 1)) FILTER (i <= 10) AS i10, sum(grade / log2(i + 1)) FILTER (i <= 20) AS i20, sum(grade / log2(i + 1)) FILTER (i <= 100) AS i100 FROM bi GROUP BY 1),
g AS (SELECT query_id, sum(grade / log2(rank + 1)) FILTER (rank <= 10) AS d10, sum(grade / log2(rank + 1)) FILTER (rank <= 20) AS d20, sum(grade / log2(rank + 1)) AS d100,
  count(*) FILTER (rank <= 10) AS f10, count(*) FILTER (rank <= 20) AS f20, count(*) AS f100, sum(nth::DOUBLE / rank) AS p, min(rank) FILTER (rank <= 10) AS first FROM n GROUP BY 1),
run AS (SELECT query_id, unnest(['ndcg@10', 'ndcg@20', 'ndcg@100', 'recall@10', 'recall@20', 'recall@100', 'map@100', 'mrr@10']) AS metric,
  unnest([round(coalesce(d10 / i10, 0), 6), round(coalesce(d20 / i20, 0), 6), round(coalesce(d100 / i100, 0), 6), round(coalesce(f10::DOUBLE / n_rel, 0), 6), round(coalesce(f20::DOUBLE / n_rel, 0), 6), round(coalesce(f100::DOUBLE / n_rel, 0), 6),
    round(coalesce(p / n_rel, 0), 6), round(coalesce(1.0::DOUBLE / first, 0), 6)]) AS value FROM judged_q JOIN b USING (query_id) LEFT JOIN g USING (query_id))
"""


def whole_run(spark, sf):
    q, d = C.vecs(spark, sf)
    return M.evaluate_run(X.topk(q, d, 100), C.judged(q, d))


@query("evaluate_run", RUN + "SELECT query_id, metric, value FROM run")
def evaluate_run(spark, sf):
    return whole_run(spark, sf)


@query("run_means", RUN + "SELECT metric, count(*) AS n, round(avg(value), 6) AS mean FROM run GROUP BY 1")
def run_means(spark, sf):
    return M.means(whole_run(spark, sf))


@query("pick_rows", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE coalesce(nullif(l_returnflag, 'N'), 'none') = 'none' AND coalesce(l_linestatus, 'O') = 'O' AND abs(l_discount - 0.05::DOUBLE) < 1e-6 AND abs(l_tax - 0.02::DOUBLE) < 1e-6")
def pick_rows(spark, sf):
    """Rows by fields, of which one is missing where nothing was returned, and by numbers within a tolerance."""
    l = table(spark, sf, "lineitem").withColumn("flag", F.nullif("l_returnflag", F.lit("N")))
    return R.pick(l, {"flag": ("none", "none"), "l_linestatus": ("O", "O")}, {"l_discount": 0.05, "l_tax": 0.02}).select("l_orderkey", "l_linenumber")


@query("tail_means", "SELECT event_type, round(avg(value), 6) AS mean FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 50 GROUP BY 1")
def tail_means(spark, sf):
    return R.tail_mean(table(spark, sf, "events"), ["event_type"], [F.col("ts"), F.col("event_id")], "value", 50)


@query(
    "pivot_measures",
    "SELECT source, " + ", ".join(f"coalesce(nullif(count(*) FILTER (lang = '{v}'), 0)::VARCHAR, '–') AS {v}_n, coalesce(round(avg(n_chars) FILTER (lang = '{v}'), 0)::BIGINT::VARCHAR, '–') AS {v}_chars" for v in ("en", "de", "fr")) + " FROM documents GROUP BY 1",
)
def pivot_measures(spark, sf):
    return R.pivot_measures(table(spark, sf, "documents"), "source", "lang", ["en", "de", "fr"], {"n": F.count(F.lit(1)), "chars": F.round(F.avg("n_chars")).cast("long")})


@query("predictions", """WITH x AS (SELECT avg(n_chars) AS m, max(n_chars) AS h, avg(CASE WHEN lang = 'xx' THEN n_chars END) AS z, avg(doc_id % 2) - 0.5 AS e FROM documents)
SELECT 'mean of at least 1,500' AS name, round(m, 6) AS observed, 1500.0::DOUBLE AS bound, m >= 1500 AS holds FROM x UNION ALL SELECT 'none of 1,000 or more', h, 1000, h < 1000 FROM x
UNION ALL SELECT 'unseen language', round(z, 6), 1, z >= 1 FROM x UNION ALL SELECT 'even ids', round(e, 6), 0.01, abs(e) <= 0.01 FROM x""")
def predictions(spark, sf):
    x = table(spark, sf, "documents").agg(F.avg("n_chars").alias("m"), F.max("n_chars").alias("h"), F.avg(F.when(F.col("lang") == "xx", F.col("n_chars"))).alias("z"), (F.avg(F.col("doc_id") % 2) - 0.5).alias("e"))
    return R.predictions(x, [("mean of at least 1,500", F.col("m"), ">=", 1500), ("none of 1,000 or more", F.col("h"), "<", 1000), ("unseen language", F.col("z"), ">=", 1), ("even ids", F.col("e"), "within", 0.01)])


@query("arms_compared", """WITH p AS (SELECT event_type, user_id, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS arm, quantile_cont(value, 0.5) AS p50 FROM events GROUP BY 1, 2),
g AS (SELECT event_type, min(p50) FILTER (arm = 'even') AS el, max(p50) FILTER (arm = 'even') AS em, avg(p50) FILTER (arm = 'even') AS ea, min(p50) FILTER (arm = 'odd') AS ol, max(p50) FILTER (arm = 'odd') AS om, avg(p50) FILTER (arm = 'odd') AS oa FROM p GROUP BY 1)
SELECT event_type, round(el, 6) AS even_least, round(em, 6) AS even_most, round(ol, 6) AS odd_least, round(om, 6) AS odd_most, round(greatest(ea, oa) / nullif(least(ea, oa), 0), 6) AS ratio, ea > oa AS slower FROM g WHERE ea IS NOT NULL AND oa IS NOT NULL""")
def arms_compared(spark, sf):
    p = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.percentile("value", 0.5).alias("p50"))
    return R.arms_compared(p.withColumn("arm", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd")), ["event_type"], "arm", "p50", "even", "odd")


@query("best_known", """WITH a AS (SELECT source, round(avg(quality), 6) AS v FROM documents JOIN labels USING (doc_id) WHERE lang = 'fr' GROUP BY 1), b AS (SELECT source, round(avg(toxic), 6) AS v FROM documents JOIN labels USING (doc_id) WHERE lang = 'es' GROUP BY 1)
SELECT source, coalesce(a.v, b.v, CASE source WHEN 'src0' THEN 0.5::DOUBLE WHEN 'src3' THEN 0.25::DOUBLE END) AS v, CASE WHEN a.v IS NOT NULL THEN 'fr' WHEN b.v IS NOT NULL THEN 'es' WHEN source IN ('src0', 'src3') THEN 'constant' END AS origin
FROM (SELECT DISTINCT source FROM documents) LEFT JOIN a USING (source) LEFT JOIN b USING (source)""")
def best_known(spark, sf):
    """A source's number from what was measured in French, else in Spanish, else a constant, with where it is from."""
    d = table(spark, sf, "documents")
    j = d.join(table(spark, sf, "labels"), "doc_id")
    mean = lambda lang, c: j.where(F.col("lang") == lang).groupBy("source").agg(F.round(F.avg(c), 6).alias("v"))
    return R.best_known(d.select("source").distinct(), "source", [("fr", mean("fr", "quality")), ("es", mean("es", "toxic"))], "v", {"src0": 0.5, "src3": 0.25})


def _readout(name: str, value: str) -> str:
    """One variant against the plain reading, in SQL: the draws of catalogue.BOOT under names of its own."""
    return f""", x{name} AS (SELECT query_id, {value} AS d FROM ev JOIN evc USING (query_id)), p{name} AS (SELECT d AS v, row_number() OVER (ORDER BY query_id) - 1 AS pos FROM x{name} WHERE d IS NOT NULL), n{name} AS (SELECT count(*) AS size FROM p{name}),
draw{name} AS (SELECT rep, ('0x' || substr(md5('7:' || rep || ':' || i), 1, 8))::BIGINT % size AS pos FROM n{name}, generate_series(0, 199) a(rep), generate_series(0, size - 1) b(i)),
m{name} AS (SELECT rep, avg(v) AS m FROM draw{name} JOIN p{name} USING (pos) GROUP BY 1),
o{name} AS (SELECT '{name}' AS variant, (SELECT count(*) FROM p{name}) AS n, round((SELECT avg(v) FROM p{name}), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m{name})"""


@query("readouts", BASE + _readout("client", "evc.ndcg - ev.ndcg") + _readout("precision", "ev.ap - ev.ndcg") + " SELECT *, CASE WHEN lo > 0 OR hi < 0 THEN '*' ELSE '' END AS star FROM (FROM oclient UNION ALL FROM oprecision)")
def readouts(spark, sf):
    """Two variants of a reading against the plain one, over the same queries."""
    fp, client = C.both(spark, sf)
    as_x = lambda df, c: df.select("query_id", F.col(c).alias("x"))
    return S.readouts(as_x(fp, "ndcg"), {"client": as_x(client, "ndcg"), "precision": as_x(fp, "ap")}, "x", C.DRAWS, C.SEED)


@query("minhash_params", "SELECT source, count(*) AS n_docs, CASE WHEN count(*) * 1000 > 50000 THEN 32 ELSE 64 END AS permutations, CASE WHEN count(*) * 1000 > 50000 THEN 800 ELSE 2000 END AS chars FROM documents GROUP BY 1")
def minhash_params(spark, sf):
    """Parameters for corpora a thousand times as large as each source."""
    n = {r["source"]: r["n"] for r in table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n")).collect()}  # one row for each source
    return spark.createDataFrame([(s, k, *P.minhash_params(1000 * k)) for s, k in n.items()], "source string, n_docs long, permutations int, chars int")


@query("shingle_counts_cut", f"""WITH w AS (SELECT doc_id, string_split(trim({NORM.format(x='text')}[1:2000]), ' ') AS w FROM documents WHERE {NORM.format(x='text')} <> '')
SELECT doc_id, len(list_distinct(list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i:i + 4], ' ')))) AS n FROM w""")
def shingle_counts_cut(spark, sf):
    """Shingles of the beginnings that sketches of small corpora are made of."""
    return P.shingle_sets(table(spark, sf, "documents"), F.col("text"), max_chars=P.minhash_params(0)[1]).select("doc_id", F.col("n").cast("long").alias("n"))


@query("reservoir", """SELECT doc_id, kept FROM (SELECT doc_id, true AS kept FROM documents SEMI JOIN labels USING (doc_id)
UNION ALL SELECT doc_id, false FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) AS k FROM documents ANTI JOIN labels USING (doc_id)) WHERE k <= greatest(700 - (SELECT count(DISTINCT doc_id) FROM labels), 0))""")
def reservoir(spark, sf):
    return P.reservoir(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), 700, C.SEED)[0].select("doc_id", "kept")


@query("reservoir_stats", "SELECT count(*) AS raw_total, count(l.doc_id) AS kept, count(*) - count(l.doc_id) AS negatives_seen FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def reservoir_stats(spark, sf):
    return P.reservoir(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), 700, C.SEED)[1]


@query("restrict_to_splits", f"WITH {GRADES}, s AS (SELECT DISTINCT query_id, {C.SPLIT.replace('doc_id', 'query_id')} AS split FROM g) SELECT query_id, count(*) AS n FROM g SEMI JOIN (SELECT query_id FROM s WHERE split <> 'test') USING (query_id) GROUP BY 1")
def restrict_to_splits(spark, sf):
    g = C.grades(spark, sf)
    s = C.splits(g.select("query_id").distinct(), "query_id").where("split != 'test'")
    return P.restrict(g.select("query_id").distinct(), g, s)[1].groupBy("query_id").agg(F.count("*").alias("n"))


BUILT = HASHED.replace("WITH h", "WITH RECURSIVE h") + f""", m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY hash) AS canonical FROM h), corpus AS (SELECT * FROM documents SEMI JOIN (SELECT doc_id FROM m WHERE doc_id = canonical) USING (doc_id)),
{GRADES.replace('JOIN documents', "JOIN (SELECT doc_id, lang || '-' || source AS source FROM documents)")},
all_q AS (SELECT DISTINCT query_id FROM g UNION SELECT 'nobody'), all_j AS (SELECT * FROM g UNION ALL SELECT 'nobody', -1, 1),
gm AS (SELECT query_id, coalesce(canonical, doc_id) AS doc_id, max(grade) AS grade FROM all_j LEFT JOIN m USING (doc_id) GROUP BY 1, 2),
k AS (SELECT query_id, row_number() OVER (ORDER BY md5('7:' || query_id), query_id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT query_id FROM all_j)),
sp AS (SELECT query_id, CASE WHEN k <= greatest(1, round_even(n * 0.4::DOUBLE, 0)) THEN 'train' WHEN k <= greatest(1, round_even(n * 0.4::DOUBLE, 0)) + greatest(1, round_even(n * 0.1::DOUBLE, 0)) THEN 'dev' ELSE 'test' END AS split FROM k),
there AS (SELECT gm.* FROM gm SEMI JOIN corpus USING (doc_id)), orph AS (SELECT query_id FROM all_q ANTI JOIN there USING (query_id)),
sp2 AS (SELECT * FROM sp ANTI JOIN orph USING (query_id)), per AS (SELECT query_id, count(*) FILTER (grade >= 1) AS n, max(grade) AS g FROM there GROUP BY 1),
w AS (SELECT doc_id, string_split({NORM.format(x='text')}, ' ') AS w FROM corpus WHERE {NORM.format(x='text')} <> ''),
sh AS (SELECT doc_id, list_distinct(list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w),
item AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sh), rare AS (SELECT x FROM item GROUP BY x HAVING count(*) > 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM item a JOIN rare USING (x) JOIN item b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.9),
e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
grp AS (SELECT a AS doc_id, least(a, min(b)) AS group_id FROM reach GROUP BY a),
rel AS (SELECT query_id, split, group_id FROM there JOIN sp2 USING (query_id) JOIN grp USING (doc_id) WHERE grade >= 1)
SELECT (SELECT count(*) FROM corpus) AS n_docs, (SELECT quantile_cont({WORDS}, 0.5) FROM corpus) AS median_doc_words, (SELECT count(*) FROM all_q ANTI JOIN orph USING (query_id)) AS n_queries,
(SELECT round(avg(n), 6) FROM per) AS relevant_per_query, (SELECT bool_or(g > 1) FROM per) AS graded, (SELECT count(*) FROM gm ANTI JOIN corpus USING (doc_id)) AS dangling, (SELECT count(*) FROM orph) AS orphaned,
(SELECT count(*) FROM documents) - (SELECT count(*) FROM corpus) AS exact_removed, (SELECT count(DISTINCT group_id) FROM grp) AS near_groups, (SELECT count(DISTINCT query_id) FROM rel WHERE split = 'test' AND group_id IN (SELECT group_id FROM rel WHERE split = 'train')) AS flagged,
(SELECT count(*) FROM sp2 WHERE split = 'train') AS n_train, (SELECT count(*) FROM sp2 WHERE split = 'dev') AS n_dev, (SELECT count(*) FROM sp2 WHERE split = 'test') AS n_test, (SELECT count(*) FROM sp) AS n_queries_total, 'synthetic_from_test' AS split_source"""


@query("build_dataset", BUILT)
def build_dataset(spark, sf):
    """Preparation from end to end: a query for each language and source, one of them judged with a document that is not there."""
    d = table(spark, sf, "documents")
    name = F.concat("lang", F.lit("-"), "source")
    j = table(spark, sf, "labels").join(d.select("doc_id", name.alias("query_id")), "doc_id").select("query_id", "doc_id", (F.col("quality") + 1 - F.col("toxic")).cast("long").alias("grade"))
    j = j.unionByName(spark.createDataFrame([("nobody", -1, 1)], "query_id string, doc_id long, grade long"))
    q = j.select("query_id", F.col("query_id").alias("text")).distinct()
    meta = P.build(d.select("doc_id", "text"), q, {"test": j}, None, C.SEED)["meta"]
    return meta.select("n_docs", "median_doc_words", "n_queries", "relevant_per_query", "graded", "dangling", "orphaned", "exact_removed", "near_groups", "flagged", "n_train", "n_dev", "n_test", "n_queries_total", "split_source")


@query("embedding_cache", "SELECT vec_id::VARCHAR AS id, len(embedding) AS dim, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings UNION ALL SELECT 'q' || vec_id, len(embedding), round(list_sum(embedding::DOUBLE[]), 6) FROM embeddings WHERE vec_id % 10 = 0")
def embedding_cache(spark, sf):
    """Vectors written to a cache with their provenance, and read back."""
    e, path = table(spark, sf, "embeddings"), f"{folder(spark)}/vectorloom-cache-{uuid.uuid4().hex}"
    D.save_embeddings(path, e.select(F.col("vec_id").cast("string").alias("id"), "embedding"), e.where("vec_id % 10 = 0").select(F.concat(F.lit("q"), F.col("vec_id").cast("string")).alias("id"), "embedding"), {"teacher": "given"})
    got = D.load_embeddings(spark, path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return got["corpus"].unionByName(got["queries"]).select("id", F.size("embedding").cast("long").alias("dim"), F.round(total, 6).alias("total"))


@query("per_query_values", RUN + "SELECT query_id::VARCHAR AS query_id, metric, value FROM run WHERE metric = 'ndcg@10'")
def per_query_values(spark, sf):
    """The values of each query, written by data set and system and read back for one of them."""
    path = f"{folder(spark)}/vectorloom-values-{uuid.uuid4().hex}"
    run = whole_run(spark, sf).select(F.col("query_id").cast("string").alias("query_id"), "metric", "value", F.lit("own").alias("dataset"))
    D.save_per_query(run.withColumn("system", F.lit("trusted")).unionByName(run.withColumn("system", F.lit("other"))), path)
    return D.load_per_query(spark, path, "own", "trusted").where("metric = 'ndcg@10'").select("query_id", "metric", "value")


@query("kquant3")
def kquant3(spark, sf):
    """The vectors, four ids at a time, as super-blocks of 256 weights at 3 bits."""
    return Q.quantise_blocks(C.super_blocks(spark, sf), 3).select("block", F.length("packed").cast("long").alias("bytes"), F.round("mse", 9).alias("mse"), F.round("max_err", 6).alias("max_err"))



IMX = "'model-0.6b-imx-' || CASE doc_id % 4 WHEN 0 THEN 'IQ2_M' WHEN 1 THEN 'Q2_K' WHEN 2 THEN 'IQ2_XS' ELSE 'Q3_K' END || CASE WHEN doc_id % 3 = 0 THEN 'pure' ELSE '' END || '-' || CASE doc_id % 5 WHEN 0 THEN 'generic_wikitext' WHEN 1 THEN 'noimatrix' WHEN 2 THEN lang || '_corpus_only' ELSE 'scifact_corpus_only' END || CASE WHEN doc_id % 11 = 0 THEN '.gguf' ELSE '-tabQ2_K.gguf' END"


@query("describe_files", rf"""WITH n AS (SELECT doc_id, {IMX} AS name FROM documents), x AS (SELECT *, regexp_extract(name, '^[\w.-]+?-imx-([A-Z0-9_]+?)(pure)?-(.+)-tabQ2_K\.gguf$', ['t', 'p', 'c']) AS m FROM n),
y AS (SELECT doc_id, m.t AS t, m.p <> '' AS pure, m.c AS c, m.t <> '' AS ok, CASE m.t || '/' || m.c WHEN 'IQ2_M/generic_wikitext' THEN 'A' WHEN 'IQ2_M/scifact_corpus_only' THEN 'B' WHEN 'Q2_K/scifact_corpus_only' THEN 'C'
  WHEN 'Q2_K/generic_wikitext' THEN 'D' WHEN 'Q2_K/noimatrix' THEN 'E' WHEN 'IQ2_XS/scifact_corpus_only' THEN 'F' ELSE '' END AS l FROM x)
SELECT doc_id, CASE WHEN ok THEN t ELSE '?' END AS ftype, CASE WHEN ok THEN c ELSE '?' END AS calib, CASE WHEN NOT ok THEN '?' WHEN c = 'noimatrix' THEN '—' ELSE '300k' END AS budget, ok AND pure AS pure,
CASE WHEN NOT ok THEN '?' WHEN pure AND l <> '' THEN l || chr(39) WHEN pure THEN 'pure' ELSE l END AS arm FROM y""")
def describe_files(spark, sf):
    """Files named by each document's number and language, some of another kind."""
    i = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ("IQ2_M", "Q2_K", "IQ2_XS", "Q3_K"))), (i % 4 + 1).cast("int"))
    calib = F.when(i % 5 == 0, "generic_wikitext").when(i % 5 == 1, "noimatrix").when(i % 5 == 2, F.concat("lang", F.lit("_corpus_only"))).otherwise("scifact_corpus_only")
    name = F.concat(F.lit("model-0.6b-imx-"), kind, F.when(i % 3 == 0, "pure").otherwise(""), F.lit("-"), calib, F.when(i % 11 == 0, ".gguf").otherwise("-tabQ2_K.gguf"))
    return table(spark, sf, "documents").select("doc_id", T.describe_file(name, "300k").alias("d")).select("doc_id", "d.ftype", "d.calib", "d.budget", "d.pure", "d.arm")


@query("calibration_logs", r"""WITH l AS (SELECT conv_id, string_agg(CASE WHEN turn % 2 = 0 THEN 'x [calib] a.txt: ' || length(text) || ' sequences = ' || 7 * length(text) || ' tokens y' ELSE 'n_seq=' || length(text) || ' per_sample' END, chr(10) ORDER BY turn) AS log FROM conversations WHERE (conv_id + turn) % 3 <> 0 GROUP BY 1)
SELECT conv_id, coalesce(try_cast(regexp_extract(log, '\[calib\] \S+: (\d+) sequences = (\d+) tokens', 1) AS BIGINT), try_cast(regexp_extract(log, 'n_seq=(\d+) per_sample', 1) AS BIGINT)) AS sequences,
coalesce(try_cast(regexp_extract(log, '\[calib\] \S+: (\d+) sequences = (\d+) tokens', 2) AS BIGINT), 512 * try_cast(regexp_extract(log, 'n_seq=(\d+) per_sample', 1) AS BIGINT)) AS tokens FROM l""")
def calibration_logs(spark, sf):
    """Logs of a line for each turn of a conversation, some turns left out: what they say of sequences and tokens."""
    n = F.char_length("text").cast("string")
    line = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("x [calib] a.txt: "), n, F.lit(" sequences = "), (7 * F.char_length("text")).cast("string"), F.lit(" tokens y"))).otherwise(F.concat(F.lit("n_seq="), n, F.lit(" per_sample")))
    c = table(spark, sf, "conversations").where((F.col("conv_id") + F.col("turn")) % 3 != 0).select("conv_id", "turn", line.alias("line"))
    logs = c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("log"))
    return logs.select("conv_id", T.calibration_tokens(F.col("log")).alias("c")).select("conv_id", "c.sequences", "c.tokens")


@query("known_ids", "WITH asked AS (SELECT vec_id * 3 AS doc_id FROM embeddings) SELECT doc_id, true AS known FROM documents SEMI JOIN asked USING (doc_id) UNION ALL SELECT doc_id, false FROM (SELECT DISTINCT doc_id FROM asked) ANTI JOIN documents USING (doc_id)")
def known_ids(spark, sf):
    have, lost = P.only(table(spark, sf, "documents"), table(spark, sf, "embeddings").select((F.col("vec_id") * 3).alias("doc_id")))
    return have.select("doc_id", F.lit(True).alias("known")).unionByName(lost.select("doc_id", F.lit(False).alias("known")))


@query("split_members", f"SELECT doc_id AS pos, doc_id AS query_id FROM (SELECT doc_id, {C.SPLIT} AS split FROM documents) WHERE split = 'test' AND doc_id IN (SELECT vec_id FROM embeddings)")
def split_members(spark, sf):
    s = C.splits(table(spark, sf, "documents")).withColumn("pos", F.col("query_id"))
    return P.members(s, "test", table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id")))


@query("drawn_paragraphs", rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents), p AS (SELECT doc_id, pos, {C.STRIP.format(x='line')} AS s FROM l),
ok AS (SELECT doc_id, pos FROM p WHERE s <> '' AND NOT (s[1] IN ('*', '-', '#', ':', '|', '{{', '!', '=', '•')) AND s[-1] IN ('.', '!', '?', '"', '“', '”', '»', ')') AND position('|' IN s) = 0 AND position('{{{{' IN s) = 0 AND position('}}}}' IN s) = 0
  AND position('[[' IN s) = 0 AND position(chr(9) IN s) = 0 AND len(list_filter(regexp_split_to_array(s, '[\s\p{{Z}}]+'), lambda w: w <> '')) BETWEEN 10 AND 200 AND (length(s) - length(regexp_replace(s, '\p{{Nd}}', '', 'g'))) <= 0.10 * length(s)
  AND position('může znamenat' IN s[1:80]) = 0 AND position('může být' IN s[1:40]) = 0),
one AS (SELECT doc_id, min_by(pos, md5('7:' || doc_id || ':' || pos)) AS pos FROM ok GROUP BY 1)
SELECT doc_id, pos::INT AS pos FROM one ORDER BY md5('7:' || doc_id), doc_id LIMIT 200""")
def drawn_paragraphs(spark, sf):
    return P.paragraphs(table(spark, sf, "documents"), 10, 200, 200, C.SEED).select("doc_id", "pos")


@query("by_kind", "SELECT source AS name, 'file' AS kind, avg(n_chars) AS value, NULL::BIGINT AS n FROM documents WHERE lang = 'en' GROUP BY 1 UNION ALL SELECT lang, 'grid', avg(n_chars), count(*) FROM documents GROUP BY 1")
def by_kind(spark, sf):
    """Numbers measured in two ways, one of them with a count, as one table with where each is from."""
    d = table(spark, sf, "documents")
    one = d.where("lang = 'en'").groupBy(F.col("source").alias("name")).agg(F.avg("n_chars").alias("value"))
    return R.with_kind({"file": one, "grid": d.groupBy(F.col("lang").alias("name")).agg(F.avg("n_chars").alias("value"), F.count("*").alias("n"))})


@query("decide_by_arms", """WITH a AS (SELECT source, lang, avg(n_chars) / 1000 AS v FROM documents WHERE NOT (lang = 'de' AND source IN ('src1', 'src2', 'src3')) AND NOT (lang = 'fr' AND source IN ('src2', 'src4')) GROUP BY 1, 2),
g AS (SELECT source, max(v) FILTER (lang = 'en') AS t, max(v) FILTER (lang = 'de') AS d, max(v) FILTER (lang = 'fr') AS f FROM a GROUP BY 1)
SELECT source, CASE WHEN d IS NOT NULL THEN 'de' WHEN f IS NOT NULL THEN 'fr' END AS reference, round(t - coalesce(d, f), 6) AS delta, CASE WHEN t - coalesce(d, f) IS NULL THEN 'cannot decide' WHEN t - coalesce(d, f) >= 0.01 AND t - coalesce(d, f) - 0.1 > 0 THEN 'yes' ELSE 'no' END AS decision FROM g""")
def decide_by_arms(spark, sf):
    """English against German, else against French; some arms are missing."""
    d = table(spark, sf, "documents").where("NOT (lang = 'de' AND source IN ('src1', 'src2', 'src3')) AND NOT (lang = 'fr' AND source IN ('src2', 'src4'))")
    a = d.groupBy("source", "lang").agg((F.avg("n_chars") / 1000).alias("v"))
    return R.decide_by_arms(a, ["source"], "lang", "v", "en", ["de", "fr"], F.lit(0.1))


@query("verification", BASE + """, t AS (SELECT query_id, evc.ndcg AS v, ev.ndcg AS r, (query_id % 97)::DOUBLE AS ms FROM evc JOIN ev USING (query_id))
SELECT count(*) AS n, round(avg(v), 6) AS mean, round(avg(r), 6) AS reference_mean, count(*) FILTER (abs(v - r) > 1e-3) AS n_diff, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95, round(avg(ms), 6) AS mean_ms FROM t""")
def verification(spark, sf):
    """The client's run against the trusted one, with latencies made of the ids."""
    fp, client = C.both(spark, sf)
    run = client.select("query_id", F.col("ndcg").alias("value"), (F.col("query_id") % 97).cast("double").alias("ms"))
    return R.verification(run, fp.select("query_id", F.col("ndcg").alias("value")))


@query("assigned_types", "SELECT (ps_partkey % 12)::BIGINT AS layer, 'name' || (ps_suppkey % 5) AS name, CASE WHEN ps_suppkey % 5 = 2 OR ps_partkey % 12 >= 10 THEN 'Q3_K' ELSE 'Q2_K' END AS type FROM (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey FROM lineitem) GROUP BY ALL")
def assigned_types(spark, sf):
    l = table(spark, sf, "lineitem").select((F.col("l_partkey") % 12).alias("layer"), F.concat(F.lit("name"), (F.col("l_suppkey") % 5).cast("string")).alias("name")).distinct()
    return R.assign_types(l, "Q2_K", "Q3_K", ["name2"], 2)


@query("both_sides", BASE + """, dc0 AS (SELECT doc_id, e, list_max(list_transform(e, lambda x: abs(x))) / 7 AS s FROM (SELECT vec_id AS doc_id, e FROM v)),
dc AS (SELECT doc_id, list_transform(list_transform(e, lambda x: greatest(least(round_even(x / greatest(s, 1e-12), 0), 7), -7) * s), lambda x: x) AS y FROM dc0),
du AS (SELECT doc_id, list_transform(y, lambda x: x / greatest(sqrt(list_dot_product(y, y)), 1e-12)) AS w FROM dc),
z AS (SELECT query_id, doc_id, round(list_dot_product(c.v, du.w), 6) AS score FROM c JOIN du ON query_id <> doc_id)
SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM z) WHERE rank <= 10""")
def both_sides(spark, sf):
    """Documents compressed like the queries: the symmetric kind of retrieval."""
    q, d = C.vecs(spark, sf)
    return X.topk(C.clients(q), d.select("doc_id", V.l2_normalise(V.quantised(F.col("e"), C.LEVELS)).alias("v")), 10)


@query("ridge_grid")
def ridge_grid(spark, sf):
    """Penalties and the rotation, scored on held-out queries."""
    q, _ = C.vecs(spark, sf)
    both = q.select("query_id", "v").join(C.clients(q, 1).select("query_id", F.col("v").alias("w")), "query_id")
    tried = Q.ridge_grid(both.where("query_id % 50 != 0"), both.where("query_id % 50 = 0"), "w", "v")[1]
    return spark.createDataFrame([(k, p, round(c, 6)) for k, p, c in tried], "kind string, penalty double, cosine double")
