"""Queries over files made from the tables: archives, arrays, frames as bytes, named files and lines of text."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe import storage
from lumenframe.operators import frames as P
from lumenframe.operators import metriclog
from lumenframe.plans.registry import query, read
from lumenframe.sources import archives, lines, named, npy
from lumenframe.sources import writers as K


@query("""SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS size, md5(coalesce(text, '')) AS text_md5, CAST(doc_id AS INTEGER) AS stem FROM documents WHERE lang = 'de'""")
def archive_texts(spark, sf_dir):
    """Documents written as archives of a hundred; the German ones are read back by their member names, and of others only the directory is read."""
    path = storage.new_path(spark, "archives")
    d = read(spark, sf_dir, "documents")
    zip_, member = F.concat(F.floor(F.col("doc_id") / 100).cast("string"), F.lit("_trajectory.zip")), F.concat(F.lit("t/"), "lang", F.lit("/f"), F.col("doc_id").cast("string"), F.lit(".txt"))
    archives.write_archives(d.select(zip_.alias("zip"), member.alias("member"), F.col("text").alias("content")), path)
    back = archives.archive_members(spark, path, contents=True, task_bytes=4 << 20).filter(F.col("member").startswith("t/de/"))
    return back.select(F.col("stem").cast("long").alias("doc_id"), "size", F.md5("content").alias("text_md5"), "stem")


@query("""SELECT CAST(label AS INTEGER) AS label, row, CAST(len(embedding) AS BIGINT) AS width, round(embedding[1]::DOUBLE + embedding[64]::DOUBLE, 5) AS ends FROM (
 SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS row FROM embeddings) WHERE row >= 3""")
def array_rows(spark, sf_dir):
    """One NPY file for each label of the embeddings, read back by ranges of rows from the fourth on."""
    path = storage.new_path(spark, "arrays")
    npy.write_npy(read(spark, sf_dir, "embeddings").select(F.concat(F.lit("label"), F.col("label").cast("string"), F.lit(".npy")).alias("file"), F.col("vec_id").alias("place"), F.col("embedding").alias("values")), path)
    back = npy.npy_rows(spark, path, task_bytes=64 << 10).filter("row >= 3")
    label = F.regexp_extract("path", r"label(\d+)\.npy$", 1).cast("int")
    return back.select(label.alias("label"), "row", F.get("shape", F.lit(1)).alias("width"), F.round(F.get("values", F.lit(0)) + F.get("values", F.lit(63)), 5).alias("ends"))


#: An 8 x 8 frame of each vector: red, green and blue are its sizes in hundredths, forward, backward and from the middle, modulo 256.
_PIXELS = """p AS (SELECT vec_id, i, CAST(floor(abs(embedding[i + 1]::DOUBLE) * 100) AS BIGINT) % 256 AS r, CAST(floor(abs(embedding[64 - i]::DOUBLE) * 100) AS BIGINT) % 256 AS g,
  CAST(floor(abs(embedding[(i + 32) % 64 + 1]::DOUBLE) * 100) AS BIGINT) % 256 AS b FROM embeddings, range(0, 64) x(i))"""


def _frames(spark, sf_dir):
    """Clips of ten vectors, a frame each."""
    size = lambda i: F.pmod(F.floor(F.abs(F.get("embedding", i).cast("double")) * 100), F.lit(256))
    byte = lambda x: F.lpad(F.hex(x), 2, "0")
    rows = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.concat(byte(size(i)), byte(size(63 - i)), byte(size((i + 32) % 64))))
    return read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("clip"), F.col("vec_id").alias("frame"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.unhex(F.array_join(rows, "")).alias("pixels"))


@query(f"""WITH {_PIXELS}, y AS (SELECT *, i // 8 AS h, i % 8 AS w, (r * 4899 + g * 9617 + b * 1868 + 8192) >> 14 AS gray, greatest(r, g, b) AS v, least(r, g, b) AS u FROM p),
n AS (SELECT a.*, CASE WHEN v = 0 THEN 0 ELSE ((v - u) * CAST(round_even(1044480 / v, 0) AS BIGINT) + 2048) >> 12 END AS s,
  (SELECT sum(o.gray) FROM y o WHERE o.vec_id = a.vec_id AND o.w = a.w AND o.h IN (CASE WHEN a.h = 0 THEN 1 ELSE a.h - 1 END)) + (SELECT sum(o.gray) FROM y o WHERE o.vec_id = a.vec_id AND o.w = a.w AND o.h = CASE WHEN a.h = 7 THEN 6 ELSE a.h + 1 END)
  + (SELECT sum(o.gray) FROM y o WHERE o.vec_id = a.vec_id AND o.h = a.h AND o.w = CASE WHEN a.w = 0 THEN 1 ELSE a.w - 1 END) + (SELECT sum(o.gray) FROM y o WHERE o.vec_id = a.vec_id AND o.h = a.h AND o.w = CASE WHEN a.w = 7 THEN 6 ELSE a.w + 1 END) - 4 * gray AS lap FROM y a),
f AS (SELECT vec_id, var_pop(lap) AS blur, avg(v) / 255 AS brightness, avg(s) / 255 AS saturation FROM n GROUP BY vec_id),
k AS (SELECT *, vec_id // 10 AS clip, abs(brightness - lag(brightness) OVER (PARTITION BY vec_id // 10 ORDER BY vec_id)) AS step FROM f)
SELECT clip, CAST(round(avg(blur) * 40960) AS BIGINT) AS blur_units, round(avg(brightness), 6) AS brightness_mean, round(avg(saturation), 6) AS saturation_mean, round(coalesce(avg(step), 0), 6) AS brightness_flicker, count(*) AS num_frames FROM k GROUP BY clip""")
def frame_quality(spark, sf_dir):
    """Sharpness, brightness, saturation and flicker of clips, from the bytes of their frames; sharpness in 40,960ths, which are whole numbers here."""
    q = P.clip_quality(P.frame_statistics(_frames(spark, sf_dir)))
    # One in about a hundred means lies on a rounding edge; the SQL scales and then rounds the double, where round(x, 6) goes by its decimal digits.
    six = lambda c: (F.round(F.col(c) * 1e6) / 1e6).alias(c)
    return q.select("clip", F.round(F.col("blur_var_mean") * 40960).cast("long").alias("blur_units"), *[six(c) for c in ("brightness_mean", "saturation_mean", "brightness_flicker")], "num_frames")


@query(f"""WITH {_PIXELS}, c AS (SELECT vec_id, i // 8 AS h, i % 8 AS w, unnest([0, 1, 2]) AS ch, unnest([r, g, b])::DOUBLE AS x FROM p),
two AS (SELECT a.vec_id, a.h, a.w, a.ch, a.x, b.x AS y FROM c a JOIN c b ON b.vec_id = a.vec_id + 10 AND a.h = b.h AND a.w = b.w AND a.ch = b.ch),
m AS (SELECT vec_id, ch, top, lft, avg(x) AS mx, avg(y) AS my, avg(x * x) AS xx, avg(y * y) AS yy, avg(x * y) AS xy FROM two, range(0, 2) t(top), range(0, 2) l(lft) WHERE h BETWEEN top AND top + 6 AND w BETWEEN lft AND lft + 6 GROUP BY ALL),
s AS (SELECT vec_id, (2 * mx * my + 6.5025) * (2 * 49 / 48.0 * (xy - mx * my) + 58.5225) / ((mx * mx + my * my + 6.5025) * (49 / 48.0 * (xx - mx * mx + yy - my * my) + 58.5225)) AS s FROM m),
f AS (SELECT vec_id, avg(s) AS ssim FROM s GROUP BY vec_id)
SELECT vec_id // 10 AS clip, round(avg(ssim), 6) AS ssim, count(*) AS frames FROM f GROUP BY 1""")
def frame_ssim(spark, sf_dir):
    """Structural similarity of each clip to the next one, frame by frame."""
    one = _frames(spark, sf_dir)
    other = one.withColumns({"clip": F.col("clip") - 1, "frame": F.col("frame") - 10})
    return P.clip_similarity(P.frame_similarity(one, other)).select("clip", F.round("ssim", 6).alias("ssim"), "frames")


@query(f"""WITH {_PIXELS} SELECT vec_id // 10 AS clip, CAST(vec_id % 10 // 3 AS INTEGER) AS frame, round(avg(greatest(r, g, b)) / 255, 6) AS brightness, round(avg((r * 4899 + g * 9617 + b * 1868 + 8192) >> 14), 6) AS gray_mean
FROM p WHERE vec_id % 10 IN (0, 3, 6) GROUP BY ALL""")
def clip_table_function(spark, sf_dir):
    """Clips held as one value each, taken apart by a table function: three frames of each, every third one."""
    whole = _frames(spark, sf_dir).groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("frame", "pixels"))).alias("f"), F.first("width").alias("width"), F.first("height").alias("height"))  # ten of each
    clips = whole.select("clip", "width", "height", F.unhex(F.array_join(F.transform("f", lambda x: F.hex(x["pixels"])), "")).alias("pixels"))
    out = P.frame_statistics(P.clip_frames(clips, most=3, stride=3))
    return out.select("clip", "frame", *[F.round(c, 6).alias(c) for c in ("brightness", "gray_mean")])


@query("""SELECT lang || '.jsonl' AS file, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS line, count(*) OVER (PARTITION BY lang) AS said FROM documents""")
def named_split_files(spark, sf_dir):
    """One file of JSON lines for each language, under its own name; lines are numbered as they stand in the files."""
    path = storage.new_path(spark, "named")
    said = K.write_split_files(read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("split"), "source"), path, ["doc_id"])
    rows = lines.numbered_lines(spark, path)
    counts = spark.createDataFrame(list(said.items()), "split string, said long")
    out = rows.select(F.element_at(F.split("file", "/"), -1).alias("file"), F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), "line")
    return out.join(F.broadcast(counts), F.col("file") == F.concat("split", F.lit(".jsonl"))).select("file", "doc_id", "line", "said")  # a row for each split


@query("""SELECT source || '.jsonl' AS file, line, doc_id FROM (SELECT replace(source, '/', '_') AS source, doc_id, row_number() OVER (PARTITION BY replace(source, '/', '_') ORDER BY doc_id) * 2 - 1 AS line FROM documents) WHERE doc_id % 17 = 3""")
def bad_lines(spark, sf_dir):
    """File and line of the lines that aren't JSON, in files with a blank line after each record."""
    path = storage.new_path(spark, "lines")
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.translate("source", "/", "_"), F.lit(".jsonl")).alias("file"))
    record = F.when(F.col("doc_id") % 17 == 3, F.concat(F.lit('{"doc_id": '), F.col("doc_id").cast("string"))).otherwise(F.to_json(F.struct("doc_id")))
    both = d.withColumn("line", F.explode(F.array(record, F.lit("")))).withColumn("blank", F.col("line") == "")
    named.write_named(both, path, ["doc_id", "blank"])
    found = lines.bad_json_lines(spark, path)
    return found.select(F.element_at(F.split("file", "/"), -1).alias("file"), "line", F.regexp_extract("value", r"(\d+)$", 1).cast("long").alias("doc_id"))


@query("""SELECT event_id AS step, m.key AS key, m.kind AS kind, m.number AS number, m.text AS text, m.flag AS flag, m.length AS length FROM (
 SELECT event_id, unnest([
  {'key': 'loss', 'kind': 'number', 'number': CAST(user_id AS DOUBLE), 'text': NULL, 'flag': NULL, 'length': NULL},
  {'key': 'props', 'kind': 'object', 'number': NULL, 'text': replace(props, ' ', ''), 'flag': NULL, 'length': NULL},
  {'key': 'tag', 'kind': 'text', 'number': NULL, 'text': event_type, 'flag': NULL, 'length': NULL},
  {'key': 'bins', 'kind': 'list', 'number': NULL, 'text': '[' || user_id || ',null,"x"]', 'flag': NULL, 'length': 3},
  {'key': 'last', 'kind': CASE WHEN event_id % 3 = 0 THEN 'null' ELSE 'flag' END, 'number': NULL, 'text': NULL, 'flag': CASE WHEN event_id % 3 > 0 THEN event_id % 3 = 1 END, 'length': NULL}]) AS m
 FROM events WHERE event_id % 5 > 1)""")
def metric_values(spark, sf_dir):
    """Payloads of numbers, texts, flags, lists and objects read by type; broken and empty ones go."""
    e = read(spark, sf_dir, "events")
    flag = F.when(F.col("event_id") % 3 == 0, "null").otherwise((F.col("event_id") % 3 == 1).cast("string"))
    whole = F.format_string('{"loss": %d, "props": %s, "tag": "%s", "bins": [%d, null, "x"], "last": %s}', "user_id", "props", "event_type", "user_id", flag)
    payload = F.when(F.col("event_id") % 5 == 0, "{broken").when(F.col("event_id") % 5 == 1, "{}").otherwise(whole)
    log = metriclog.parsed(e.select(F.col("event_id").alias("step"), payload.alias("payload")))
    return metriclog.metric_values(log)
