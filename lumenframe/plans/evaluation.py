"""Queries over evaluation tables: orders and their lines stand for clips and their scores, suppliers for models."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from lumenframe.functions import arrays as A
from lumenframe.operators import evaluation as V
from lumenframe.operators import relations as R
from lumenframe.operators import training as T
from lumenframe.plans.registry import query, read
from lumenframe.sources.writers import markdown_rows


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_remaining(spark, sf_dir):
    return V.remaining(read(spark, sf_dir, "documents").select("doc_id", "lang"), read(spark, sf_dir, "labels"), "doc_id")


@query("""WITH p AS (SELECT l_orderkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS k FROM lineitem)
SELECT o_orderkey, o_totalprice, l_extendedprice FROM orders JOIN p ON o_orderkey = l_orderkey WHERE k = 1""")
def joined_scores(spark, sf_dir):
    """Orders beside their last line."""
    line = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", "l_partkey", "l_extendedprice").alias("pos"), "l_extendedprice")
    return V.joined_scores(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), line, "o_orderkey", "pos")


@query("""SELECT n_name, row_number() OVER (ORDER BY idx NULLS LAST, n_nationkey) AS place FROM nation LEFT JOIN (SELECT r_regionkey, 10 - r_regionkey AS idx FROM region WHERE r_regionkey <> 2) ON n_regionkey = r_regionkey""")
def order_restore(spark, sf_dir):
    """Nations in the order of a manifest of regions that one is missing from; the place is made on the 25 rows."""
    n = read(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    m = read(spark, sf_dir, "region").filter("r_regionkey <> 2").select("r_regionkey", (10 - F.col("r_regionkey")).alias("idx"))
    ordered = V.in_manifest_order(n, m, "r_regionkey", "idx", "n_nationkey").coalesce(1)
    return ordered.select("n_name", (F.monotonically_increasing_id() + 1).alias("place"))


@query("SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) % 8 AS INTEGER) AS shard FROM documents")
def shards(spark, sf_dir):
    return V.shards(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 8)


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def matched_both(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    c = read(spark, sf_dir, "customer").select("c_custkey")
    return V.in_both(V.in_both(c, o.filter("o_orderstatus = 'F'"), "c_custkey"), o.filter("o_orderstatus = 'P'"), "c_custkey")


@query("""WITH a AS (SELECT o_custkey, min(CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 2 ELSE 3 END) AS best FROM orders GROUP BY 1)
SELECT c_custkey, CASE best WHEN 1 THEN 'P' WHEN 2 THEN 'F' WHEN 3 THEN 'O' END AS origin, CASE WHEN best IS NULL THEN 'missing:' || c_custkey || ':' || c_name END AS error FROM customer LEFT JOIN a ON o_custkey = c_custkey""")
def expected_vs_actual(spark, sf_dir):
    """Customers with the first kind of order that they have."""
    e = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("branch"), F.col("c_name").alias("name"))
    a = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("branch"), F.col("o_orderstatus").alias("source")).distinct()
    out = V.expected_files(e, a.join(e, "branch").withColumn("path", F.lit("p")), ["P", "F", "O"])
    return out.select(F.col("branch").alias("c_custkey"), "origin", "error")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') ORDER BY 1 LIMIT 8")
def missing_first(spark, sf_dir):
    """A report of the first eight that are missing."""
    return V.missing_first(read(spark, sf_dir, "customer").select("c_custkey"), read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicates(spark, sf_dir):
    return V.duplicates(read(spark, sf_dir, "orders"), "o_custkey")


_NUMBERS = "(SELECT l_returnflag, CASE WHEN l_orderkey % 10 = 0 THEN '' ELSE CAST(l_quantity AS VARCHAR) END AS psnr, CASE WHEN l_orderkey % 7 = 0 THEN 'nan' ELSE CAST(l_discount AS VARCHAR) END AS ssim, CAST(l_tax AS VARCHAR) AS lpips FROM lineitem)"


def _numbers(spark, sf_dir):
    k = F.col("l_orderkey")
    return read(spark, sf_dir, "lineitem").select("l_returnflag", F.when(k % 10 == 0, "").otherwise(F.col("l_quantity").cast("string")).alias("psnr"),
                                                  F.when(k % 7 == 0, "nan").otherwise(F.col("l_discount").cast("string")).alias("ssim"), F.col("l_tax").cast("string").alias("lpips"))


_LONG = f"""n AS (SELECT l_returnflag, TRY_CAST(nullif(psnr, '') AS DOUBLE) AS psnr, CASE WHEN ssim <> 'nan' THEN TRY_CAST(ssim AS DOUBLE) END AS ssim, TRY_CAST(lpips AS DOUBLE) AS lpips FROM {_NUMBERS}),
l AS (SELECT l_returnflag, psnr AS gate, unnest(['psnr', 'ssim', 'lpips']) AS metric, unnest([psnr, ssim, lpips]) AS v FROM n)"""


@query(f"WITH {_LONG} SELECT metric, count(*) AS n, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(min(v), 4) AS min, round(max(v), 4) AS max FROM l WHERE v IS NOT NULL AND gate IS NOT NULL GROUP BY 1")
def eval_report(spark, sf_dir):
    return V.metric_summary(_numbers(spark, sf_dir), ["psnr", "ssim", "lpips"])


@query(f"WITH {_LONG} SELECT metric, round(avg(v), 6) AS mean, count(*) AS n FROM l WHERE v IS NOT NULL GROUP BY 1")
def metric_means(spark, sf_dir):
    return V.metric_means(_numbers(spark, sf_dir), ["psnr", "ssim", "lpips"]).withColumn("mean", F.round("mean", 6))


@query(f"WITH {_LONG} SELECT l_returnflag AS seed, metric, round(avg(v), 6) AS mean, count(*) AS n FROM l WHERE v IS NOT NULL GROUP BY GROUPING SETS ((l_returnflag, metric), (metric))")
def seed_rollup(spark, sf_dir):
    return V.metric_means(_numbers(spark, sf_dir).withColumnRenamed("l_returnflag", "seed"), ["psnr", "ssim", "lpips"], "seed").withColumn("mean", F.round("mean", 6))


@query(f"WITH {_LONG} SELECT 'base' AS model, (SELECT count(*) FROM n) AS processed, 60000 AS total, round((SELECT avg(psnr) FROM n), 6) AS psnr, round((SELECT avg(ssim) FROM n), 6) AS ssim")
def progress(spark, sf_dir):
    return V.progress(_numbers(spark, sf_dir), ["psnr", "ssim"], 60000, "base").withColumns({c: F.round(c, 6) for c in ("psnr", "ssim")})


@query("""WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) AS model, s_acctbal AS a FROM supplier)
SELECT model, CASE WHEN CAST(model AS INTEGER) % 2 = 0 THEN round(a, 2) END AS pmf, round(a / 2, 6) AS psnr, CASE WHEN CAST(model AS INTEGER) % 5 > 0 THEN round(a / 4, 6) END AS ssim, round(a / 8, 6) AS lpips, round(a, 2) AS fvd FROM s""")
def model_summary(spark, sf_dir):
    a = F.col("s_acctbal")
    text = lambda c: c.cast("string")
    r = read(spark, sf_dir, "supplier").select(
        text(F.col("s_suppkey")).alias("model"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit('{"means":{"physics_iq_style_score":{"mean":'), text(a), F.lit("}}}"))).otherwise("{}").alias("physics"),
        F.concat(F.lit('{"aggregate_metrics":{"psnr":{"mean":'), text(a / 2), F.when(F.col("s_suppkey") % 5 > 0, F.concat(F.lit('},"ssim":{"mean":'), text(a / 4))).otherwise(""),
                 F.lit('},"lpips":{"mean":'), text(a / 8), F.lit("}}}")).alias("evaluation"),
        F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit('{"fvd":'), text(a), F.lit("}"))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit('{"aggregate_metrics":{"fvd":{"mean":'), text(a), F.lit("}}}"))).otherwise(
            F.concat(F.lit('{"metrics":{"fvd":'), text(a), F.lit("}}"))).alias("fvd"))
    return V.model_summary(r).select("model", F.round("pmf", 2).alias("pmf"), *[F.round(c, 6).alias(c) for c in ("psnr", "ssim", "lpips")], F.round("fvd", 2).alias("fvd"))


_CHECKPOINTS = """c AS (SELECT l_suppkey AS model, l_orderkey * 10 + l_linenumber AS step, l_quantity AS pmf, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_tax END AS fvd, l_discount AS psnr, l_linenumber AS ssim, l_partkey AS lpips FROM lineitem),
f AS (SELECT * REPLACE (coalesce(fvd, 'inf'::DOUBLE) AS fvd) FROM c)"""


def _checkpoints(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("model"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("step"), F.col("l_quantity").alias("pmf"),
                                                  F.when(F.col("l_linenumber") != 2, F.col("l_tax")).alias("fvd"), F.col("l_discount").alias("psnr"), F.col("l_linenumber").alias("ssim"), F.col("l_partkey").alias("lpips"))


@query(f"WITH {_CHECKPOINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY pmf DESC, fvd, psnr DESC, ssim DESC, lpips, step) AS k FROM f) SELECT model, step, pmf FROM r WHERE k = 1")
def best_checkpoint(spark, sf_dir):
    return V.best_checkpoint(_checkpoints(spark, sf_dir), ["model"]).select("model", "step", "pmf")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'P' AS failed, struct_pack(a := -floor(o_totalprice / 50000), b := o_totalprice % 1000) AS k FROM orders),
w AS (SELECT *, min(CASE WHEN NOT failed THEN k END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM o)
SELECT o_orderkey, CASE WHEN failed THEN 'failed' WHEN was IS NULL OR k < was THEN 'best' ELSE 'pruned' END AS status FROM w""")
def retention(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor(F.col("o_totalprice") / 50000).cast("double").alias("pmf"), (F.col("o_totalprice") % 1000).alias("fvd"),
                                             *[F.lit(0.0).alias(c) for c in ("psnr", "ssim", "lpips")], (F.col("o_orderstatus") == "P").alias("failed"))
    return V.retention(o, "o_custkey", "o_orderkey").select("o_orderkey", "status")


@query("""WITH v AS (SELECT vec_id // 20 AS item, vec_id % 97 = 5 AS bad, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT item, count(*) AS n, NOT bool_or(bad) AS all_finite, round(max(CASE WHEN NOT bad THEN abs(v) END), 6) AS max_abs FROM v GROUP BY 1""")
def numeric_audit(spark, sf_dir):
    """Arrays of which some hold infinite values; the largest finite size is made from the finite ones."""
    e = read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("item"), (F.col("vec_id") % 97 == 5).alias("bad"), "embedding")
    given = F.when(F.col("bad"), F.transform("embedding", lambda v: F.lit(float("inf")).cast("float"))).otherwise(F.col("embedding"))
    audit = V.numeric_audit(e.withColumn("values", given), "item", "values").drop("mean_abs", "max_abs")
    finite = V.require_finite(V.numeric_audit(e.filter("NOT bad"), "item", "embedding")).select("item", F.round("max_abs", 6).alias("max_abs"))
    return audit.join(finite, "item", "left")


@query("SELECT '| ' || r_regionkey || ' | ' || r_name || ' | ' || printf('%.4f', r_regionkey / 3.0::DOUBLE) || ' |' AS line FROM region")
def markdown(spark, sf_dir):
    return markdown_rows(read(spark, sf_dir, "region").select("r_regionkey", "r_name", (F.col("r_regionkey") / 3.0).alias("x")))


@query("""WITH e AS (SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY k) AS d FROM e)
SELECT event_id, k AS step, round(d, 3) AS step_seconds, round(k * 100.0 / 200, 4) AS percent FROM s""")
def step_clock(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp").cast("double")).withColumn("step", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    return V.step_clock(e, "user_id", "t", "step", 200).select("event_id", "step", F.round("step_seconds", 3).alias("step_seconds"), F.round("percent", 4).alias("percent"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) SELECT o_orderkey, n FROM o WHERE n % 5 = 0""")
def report_points(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("n"))
    return V.report_points(o, "o_custkey", "n", 5).select("o_orderkey", "n")


@query("""WITH b AS (SELECT i AS idx, 10.0::DOUBLE * (1 - i / 1000.0::DOUBLE) / (1 + 9.0::DOUBLE * (1 - i / 1000.0::DOUBLE)) AS sigma FROM range(0, 1000) r(i)),
t AS (SELECT *, sigma * 1000 AS timestep, CASE WHEN sigma * 1000 < 947 THEN 'low' ELSE 'high' END AS branch, exp(-2 * ((sigma * 1000 - 500) / 1000) ^ 2) AS y FROM b),
w AS (SELECT *, y - min(y) OVER () AS w FROM t)
, v AS (SELECT CAST(idx AS INTEGER) AS idx, round(sigma, 6) AS sigma, round(timestep, 6) AS timestep, branch, round(w / avg(w) OVER (), 6) AS weight, round(w / avg(w) OVER (PARTITION BY branch), 6) AS branch_weight FROM w)
SELECT event_id, v.* FROM events JOIN v ON idx = event_id % 1000""")
def noise_schedule(spark, sf_dir):
    """Every event with the noise, branch and weights of its training step (its number modulo the schedule's length)."""
    schedule = T.noise_schedule(spark).withColumns({c: F.round(c, 6) for c in ("sigma", "timestep", "weight", "branch_weight")})
    events = read(spark, sf_dir, "events").select("event_id", (F.col("event_id") % T.STEPS).cast("int").alias("idx"))
    return events.join(F.broadcast(schedule), "idx")  # a row for each step


@query("SELECT p_partkey, CAST(greatest(3 * greatest(ceil(ceil(p_size / 8.0) / 4), 1), 1) AS BIGINT) AS steps FROM part")
def step_counts(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.step_count(F.col("p_size"), 8, 4, 3).alias("steps"))


@query("""WITH e AS (SELECT vec_id, embedding, lead(embedding) OVER (PARTITION BY vec_id // 50 ORDER BY vec_id) AS n FROM embeddings)
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], n::DOUBLE[]), 6) AS cos FROM e WHERE n IS NOT NULL""")
def cosine(spark, sf_dir):
    clip = Window.partitionBy(F.floor(F.col("vec_id") / 50)).orderBy("vec_id")
    e = read(spark, sf_dir, "embeddings").withColumn("n", F.lead("embedding").over(clip)).filter("n IS NOT NULL")
    return e.select("vec_id", F.round(A.cosine(F.col("embedding"), F.col("n")), 6).alias("cos"))


_TOKENS = "t AS (SELECT vec_id, k, embedding[k * 16 + 1:k * 16 + 16]::DOUBLE[] AS u FROM embeddings, range(0, 4) r(k))"


def _tokens(spark, sf_dir):
    """The four 16-value tokens of each vector: one frame of an item."""
    t = read(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("token"), "embedding")
    return t.select(F.col("vec_id").alias("item"), F.lit(0).alias("frame"), "token", F.slice("embedding", F.col("token") * 16 + 1, 16).alias("vector"))


@query(f"WITH {_TOKENS} SELECT a.vec_id, a.k AS i, b.k AS j, round(list_cosine_similarity(a.u, b.u), 6) AS cos FROM t a JOIN t b ON a.vec_id = b.vec_id")
def token_relation(spark, sf_dir):
    """The cosine matrix of each vector's tokens in blocks of three; those on and above the diagonal are made, the others mirrored."""
    rows = R.relation_blocks(_tokens(spark, sf_dir), 3).select(F.col("item").alias("vec_id"), F.col("i").alias("first"), F.col("j").alias("start"), F.posexplode("cos").alias("i", "row"))
    out = rows.select("vec_id", "first", "start", "i", F.posexplode("row").alias("j", "cos"))
    i, j = F.col("first") + F.col("i"), F.col("start") + F.col("j")
    both = F.when(F.col("first") == F.col("start"), F.array(F.struct(i.alias("i"), j.alias("j")))).otherwise(F.array(F.struct(i.alias("i"), j.alias("j")), F.struct(j.alias("i"), i.alias("j"))))
    return out.select("vec_id", F.round("cos", 6).alias("cos"), F.explode(both).alias("p")).select("vec_id", "p.i", "p.j", "cos")


@query(f"""WITH {_TOKENS}, p AS (SELECT a.vec_id, a.k AS i, b.k AS j, list_cosine_similarity(a.u, b.u) AS cos FROM t a JOIN t b ON a.vec_id = b.vec_id)
SELECT round(avg((s.cos - x.cos) ^ 2) * 0.75, 6) AS loss FROM p s JOIN p x ON x.vec_id = s.vec_id + 1 AND s.i = x.i AND s.j = x.j""")
def trd_loss(spark, sf_dir):
    """Relations of each vector against those of the next."""
    t = _tokens(spark, sf_dir)
    return R.simple_relation_loss(t, t.withColumn("item", F.col("item") - 1), 1.0, 0.5).select(F.round("loss", 6).alias("loss"))


#: The student has 4 frames of 4 tokens, the teacher (the next vector) 8 frames of 2 tokens, all of 4 values.  Linear interpolation to 4 frames takes the mean of two teacher frames;
#: pooling to 2 tokens takes the mean of two student tokens.
@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS s, lead(embedding::DOUBLE[]) OVER (PARTITION BY vec_id // 50 ORDER BY vec_id) AS t FROM embeddings),
r AS (SELECT vec_id, f, k, list_transform(range(1, 5), lambda i: (s[f * 16 + k * 8 + i] + s[f * 16 + k * 8 + 4 + i]) / 2) AS s, list_transform(range(1, 5), lambda i: (t[f * 16 + k * 4 + i] + t[f * 16 + 8 + k * 4 + i]) / 2) AS t
      FROM e, range(0, 4) a(f), range(0, 2) b(k) WHERE t IS NOT NULL),
u AS (SELECT vec_id, f, k, list_transform(s, lambda x: x / sqrt(list_dot_product(s, s))) AS s, list_transform(t, lambda x: x / sqrt(list_dot_product(t, t))) AS t FROM r),
space AS (SELECT a.vec_id, avg(greatest(abs(list_dot_product(a.s, b.s) - list_dot_product(a.t, b.t)) - 0.1, 0)) AS spatial FROM u a JOIN u b ON a.vec_id = b.vec_id AND a.f = b.f GROUP BY 1),
m AS (SELECT a.vec_id, a.f, list_transform(range(1, 5), lambda i: (a.s[i] + b.s[i]) / 2) AS s, list_transform(range(1, 5), lambda i: (a.t[i] + b.t[i]) / 2) AS t FROM u a JOIN u b ON a.vec_id = b.vec_id AND a.f = b.f AND a.k = 0 AND b.k = 1),
time AS (SELECT a.vec_id, sum(greatest(abs(list_dot_product(a.s, b.s) - list_dot_product(a.t, b.t)) - 0.1, 0)) / 12 AS temporal FROM m a JOIN m b ON a.vec_id = b.vec_id AND a.f <> b.f GROUP BY 1)
SELECT vec_id, round(spatial, 6) AS spatial, round(temporal, 6) AS temporal, round(spatial + 0.5 * temporal, 6) AS total FROM space JOIN time USING (vec_id)""")
def relation_distillation(spark, sf_dir):
    """The whole relation loss: the teacher's frames are matched to the student's, tokens are pooled, relations compared by blocks."""
    e = read(spark, sf_dir, "embeddings").withColumn("t", F.lead("embedding").over(Window.partitionBy(F.floor(F.col("vec_id") / 50)).orderBy("vec_id"))).filter("t IS NOT NULL")

    def tokens(column: str, n: int):
        rows = e.select(F.col("vec_id").alias("item"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"), F.col(column).alias("v"))
        return rows.select("item", F.floor(F.col("k") / n).alias("frame"), (F.col("k") % n).alias("token"), F.slice("v", F.col("k") * 4 + 1, 4).alias("vector"))

    out = R.relation_distillation(tokens("embedding", 4), tokens("t", 2), 2, 0.1, 1.0, 0.5)
    return out.select(F.col("item").alias("vec_id"), *[F.round(c, 6).alias(c) for c in ("spatial", "temporal", "total")])


@query("""WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS a, list_reverse(embedding::DOUBLE[]) AS e FROM embeddings)
SELECT round(avg(list_sum(list_transform(list_zip(a, e), lambda z: (0 - (z[2] - z[1])) ^ 2)) / 64 * 1.5), 6) AS loss FROM x""")
def flow_loss(spark, sf_dir):
    """Flow-matching loss of a zero prediction, with the reversed vector as noise."""
    x = read(spark, sf_dir, "embeddings").select("embedding", F.reverse("embedding").alias("noise"), F.transform("embedding", lambda v: F.lit(0.0)).alias("zero"), F.lit(1.5).alias("w"))
    return T.flow_loss(x, "embedding", "noise", "zero", "w").select(F.round("loss", 6).alias("loss"))


@query("""WITH r AS (SELECT c_custkey AS root FROM customer), f AS (SELECT o_custkey AS root, CASE WHEN o_orderkey % 2 = 0 THEN 'low_noise_model' ELSE 'high_noise_model' END AS branch,
  CASE o_orderkey // 2 % 4 WHEN 0 THEN 'config.json' WHEN 1 THEN 'diffusion_pytorch_model.bin' ELSE 'readme' END AS name FROM orders),
w AS (SELECT root, branch FROM r, (VALUES ('low_noise_model'), ('high_noise_model')) b(branch) WHERE root IN (SELECT root FROM f)),
s AS (SELECT w.*, count(name) AS n, count_if(name = 'config.json') AS c, count_if(name LIKE 'diff%') AS x FROM w LEFT JOIN f USING (root, branch) GROUP BY ALL)
SELECT root, '' AS branch, 'missing_path' AS error FROM r WHERE root NOT IN (SELECT root FROM f) UNION ALL SELECT root, branch, 'missing_directory' FROM s WHERE n = 0
UNION ALL SELECT root, branch, 'missing_config' FROM s WHERE n > 0 AND c = 0 UNION ALL SELECT root, branch, 'missing_weights' FROM s WHERE n > 0 AND x = 0""")
def checkpoint_check(spark, sf_dir):
    """Checkpoints (customers) whose files are their orders, with what they lack."""
    return V.checkpoint_errors(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("root")), _checkpoint_files(spark, sf_dir))


def _checkpoint_files(spark, sf_dir):
    kind = F.floor(F.col("o_orderkey") / 2) % 4
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("root"), F.when(F.col("o_orderkey") % 2 == 0, "low_noise_model").otherwise("high_noise_model").alias("branch"),
                                                F.when(kind == 0, "config.json").when(kind == 1, "diffusion_pytorch_model.bin").otherwise("readme").alias("name"))


@query("""WITH f AS (SELECT o_custkey AS root, o_orderkey % 2 AS branch, o_orderkey // 2 % 4 AS kind FROM orders),
s AS (SELECT root, branch, count_if(kind = 0) AS c, count_if(kind = 1) AS x FROM f GROUP BY ALL), g AS (SELECT root, count(*) = 2 AND bool_and(c > 0 AND x > 0) AS ok FROM s GROUP BY root)
SELECT c_custkey AS root, c_name AS notes, coalesce(ok, false) AS ok, CASE WHEN ok THEN 0 ELSE coalesce(e.n, 0) + CASE WHEN ok IS NULL THEN 1 ELSE 2 - coalesce(e.there, 0) END END AS n_errors
FROM customer LEFT JOIN g ON g.root = c_custkey LEFT JOIN (SELECT root, count(*) AS there, CAST(sum(CASE WHEN c = 0 THEN 1 ELSE 0 END + CASE WHEN x = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM s GROUP BY root) e ON e.root = c_custkey""")
def lineage_check(spark, sf_dir):
    """Records of where checkpoints came from, each with the verdict on its checkpoint and the number of what it lacks."""
    records = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("root"), F.col("c_name").alias("notes"))
    return V.verified_lineage(records, _checkpoint_files(spark, sf_dir)).select("root", "notes", "ok", F.size("errors").cast("long").alias("n_errors"))


@query("""WITH s AS (SELECT o_custkey % 7 AS seed, 'psnr' AS metric, o_totalprice AS v FROM orders UNION ALL SELECT o_custkey % 7, 'fvd', o_orderkey::DOUBLE FROM orders WHERE o_custkey % 7 <> 3),
o AS (SELECT metric, format('{:.4f}', avg(v)) AS mean, count(*) AS n FROM s GROUP BY 1), p AS (SELECT seed, metric, format('{:.4f}', avg(v)) AS mean, count(*) AS n FROM s GROUP BY 1, 2)
SELECT 'overall' AS part, NULL::BIGINT AS seed, '| ' || CASE metric WHEN 'psnr' THEN 'PSNR' ELSE 'FVD' END || ' | ' || mean || ' | ' || n || ' |' AS line FROM o
UNION ALL SELECT 'seed', seed, '| ' || seed || ' | ' || max(n) || ' | ' || max(mean) FILTER (metric = 'psnr') || ' | ' || coalesce(max(mean) FILTER (metric = 'fvd'), '') || ' |' FROM p GROUP BY seed""")
def seed_summary(spark, sf_dir):
    """A formatted summary of scores by seed: a line for each metric, and one for each seed with a blank where it has none."""
    o = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).alias("seed"), F.col("o_totalprice").alias("psnr"), F.when(F.col("o_custkey") % 7 != 3, F.col("o_orderkey").cast("double")).alias("fvd"))
    means = V.seed_means(o, "seed", ["psnr", "fvd"])
    return V.summary_lines(means, V.SUMMARIES["clips"])


@query("""SELECT * FROM (SELECT c_custkey, c_mktsegment, 1 AS asked FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 1)
UNION ALL SELECT * FROM (SELECT c_custkey, c_mktsegment, 2 FROM customer ORDER BY c_custkey LIMIT 1)""")
def row_lookup(spark, sf_dir):
    """A row by its key, and the first row where no row has the key."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    found = V.row_by_key(c, "c_mktsegment", "BUILDING", "c_custkey").withColumn("asked", F.lit(1))
    return found.unionByName(V.row_by_key(c, "c_mktsegment", "none", "c_custkey").withColumn("asked", F.lit(2)))


@query("SELECT user_id % 10 + 1 AS index, round(avg(value), 6) AS loss_total_mean FROM events GROUP BY 1")
def epoch_means(spark, sf_dir):
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("epoch"), F.col("value").alias("loss_total"))
    return V.epoch_means(e).withColumn("loss_total_mean", F.round("loss_total_mean", 6))


@query("SELECT round(avg(value), 6) AS light_loss_total, count(*) AS light_sample_count FROM (SELECT value FROM events ORDER BY event_id LIMIT 200)")
def light_validation(spark, sf_dir):
    """The feature is a short check of the first 200 samples."""
    return V.light_validation(read(spark, sf_dir, "events"), "value", "event_id", 200).withColumn("light_loss_total", F.round("light_loss_total", 6))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS text FROM c GROUP BY 1")
def counter_text(spark, sf_dir):
    counts = read(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("key")).agg(F.count("*").alias("n"))
    return V.counter_text(counts, ["user_id"])


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(props ->> '$.k' AS DOUBLE) END AS k, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS n FROM events""")
def scalar_metrics(spark, sf_dir):
    """The numbers of a metric record; lists and text go."""
    k = F.get_json_object("props", "$.k")
    payload = F.concat(F.lit('{"loss": 1.5, "name": "x", "list": [1], "k": '), F.when(F.col("event_id") % 3 == 0, F.lit('"text"')).otherwise(k), F.lit("}"))
    e = read(spark, sf_dir, "events").withColumn("m", V.scalar_metrics(payload))
    return e.select("event_id", F.col("m")["k"].alias("k"), F.size("m").alias("n"))


@query("""WITH m AS (SELECT unnest(['mse_mean', 'physics_iq_style_score', 'other', 'spatial_iou']) AS metric, unnest([avg(l_tax / 7), avg(l_quantity / 7), avg(l_discount), avg(l_extendedprice / 7)]) AS mean, count(*) AS n FROM lineitem)
SELECT o AS ord, label, printf('%.4f', mean) AS text, n FROM m JOIN (VALUES (1, 'physics_iq_style_score', 'Score'), (3, 'spatial_iou', 'Spatial IoU'), (5, 'mse_mean', 'MSE')) d(o, metric, label) USING (metric)""")
def physics_summary(spark, sf_dir):
    """Metrics in the fixed order of the physics summary with their labels."""
    line = read(spark, sf_dir, "lineitem")
    means = V.metric_means(line.select((F.col("l_tax") / 7).alias("mse_mean"), (F.col("l_quantity") / 7).alias("physics_iq_style_score"), F.col("l_discount").alias("other"), (F.col("l_extendedprice") / 7).alias("spatial_iou")),
                           ["mse_mean", "physics_iq_style_score", "other", "spatial_iou"])
    return V.ordered_metrics(means, list(V.PHYSICS_LABELS), V.PHYSICS_LABELS)
