"""Sources, sinks and provenance checks, each on data that Spark derives from the tables."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.hashes import crc32c
from ..session import written
from ..sources import container
from ..sources.records import byte_span, catalogue_assets, index_spans, json_lines, positional_rows, tiered
from ..sources.sinks import stored
from ..tables import table
from .registry import registry

QUERIES, ORACLE, query = registry()


@query("select obs_id, icao, lat, t, vis from station_index")
def src_positional_rows(spark, folder):
    """SRC-03, SRC-04: rows written as JSON arrays and read back by position."""
    s = table(spark, folder, "station_index")
    cols = [("obs_id", "long"), ("icao", "string"), ("lat", "double"), ("t", "double"), ("vis", "int")]
    lines = written(s.select(F.to_json(F.array(*[F.col(c).cast("string") for c, _ in cols])).alias("line")))
    return positional_rows(lines, "line", cols)


@query("select 'read' state, count(*) n from raw_records where json_valid(payload) union all select 'unreadable', count(*) from raw_records where not json_valid(payload)")
def src_json_lines(spark, folder):
    """SRC-03: permissive scan of JSON lines; what can't be read is counted, not fatal."""
    good, bad = json_lines(table(spark, folder, "raw_records"), "payload", "icao string, wmo string, lat double")
    return good.agg(F.lit("read").alias("state"), F.count("*").alias("n")).unionByName(bad.agg(F.lit("unreadable").alias("state"), F.count("*").alias("n")))


@query("select hist_id, count(*) n from (select hist_id, unnest(metars) m from station_history) where coalesce(m.t, m.td, m.qnh, m.slp) is not null group by hist_id")
def src_history_explode(spark, folder):
    """SRC-05: nested observations with at least one value."""
    m = table(spark, folder, "station_history").select("hist_id", F.explode("metars").alias("m"))
    return m.where(F.coalesce("m.t", "m.td", "m.qnh", "m.slp").isNotNull()).groupBy("hist_id").agg(F.count("*").alias("n"))


@query("with d as (select day(obstime) d, min(byte_offset) first from station_index where byte_offset is not null group by 1) select d, first, lead(first) over (order by first) - 1 as last from d")
def src_index_spans(spark, folder):
    """SRC-07: byte spans of the days of an index: up to the next one's offset, the last one open."""
    d = table(spark, folder, "station_index").where("byte_offset is not null").groupBy(F.dayofmonth("obstime").alias("d")).agg(F.min("byte_offset").alias("first_at"))
    return index_spans(d.withColumn("size", F.lit(None).cast("long")).withColumn("_all", F.lit(1)), ["_all"], "first_at", "size").select("d", "first", "last")  # one row per day of a month


@query("select doc_id, substr(hex(encode(text)), 1, 16) head, strlen(text) > 8 longer from documents where text is not null")
def src_byte_ranges(spark, folder):
    """SRC-02: byte ranges of binary content."""
    d = table(spark, folder, "documents").where("text is not null")
    return d.select("doc_id", F.hex(byte_span(F.col("text").cast("binary"), F.lit(0), F.lit(8))).alias("head"), (F.octet_length("text") > 8).alias("longer"))


@query("select run as collection, item, variable asset, count(*) n, min(case when not isnan(median) then median end) least from plane_ceiling where variable is not null and item is not null group by all")
def src_catalogue_assets(spark, folder):
    """SRC-11, SRC-12: items with a map of assets, flattened into asset rows."""
    p = table(spark, folder, "plane_ceiling").where("variable is not null and item is not null").groupBy("run", "item", "variable").agg(F.struct(F.count("*").alias("n"), F.min(F.when(~F.isnan("median"), F.col("median"))).alias("least")).alias("v"))
    items = p.groupBy("run", "item").agg(F.map_from_entries(F.collect_list(F.struct("variable", "v"))).alias("assets"))  # an item has one asset per variable
    return catalogue_assets(items, F.col("run"), F.col("item"), F.col("assets")).select("collection", "item", "asset", "value.*")


@query("""with b as (select region, min(case model when 'boreal' then 1 when 'auster' then 2 when 'cirro9' then 3 end) k from plane_ceiling where region is not null and model in ('boreal', 'auster', 'cirro9') group by region)
 select p.region, p.model, count(*) n from plane_ceiling p join b on p.region = b.region and k = case model when 'boreal' then 1 when 'auster' then 2 when 'cirro9' then 3 end group by all""")
def src_tier_fallback(spark, folder):
    """SRC-06: per region the first tier that it has, never mixed."""
    p = table(spark, folder, "plane_ceiling").where("region is not null")
    return tiered(p, ["region"], "model", ["boreal", "auster", "cirro9"]).groupBy("region", "model").agg(F.count("*").alias("n"))


@query("select code, hour(valid_time) h, count(*) n from field_readings where hour(valid_time) in (0, 6, 12, 18) group by all")
def src_synoptic_hours(spark, folder):
    """SRC-09: the four synoptic hours."""
    return table(spark, folder, "field_readings").where(F.hour("valid_time").isin(0, 6, 12, 18)).groupBy("code", F.hour("valid_time").alias("h")).agg(F.count("*").alias("n"))


@query("select code, level_hpa, count(*) n, round(avg(value), 6) mean from field_readings join variables using (code) where level_hpa = 900 and value is not null and value <> -9999 and abs(value) < 9e36 group by all")
def src_level_scan(spark, folder):
    """SRC-08: one level of a cell table; level and time are filters, fills are dropped."""
    v = table(spark, folder, "variables").where("level_hpa = 900").select("code", "level_hpa")
    r = table(spark, folder, "field_readings").where("value is not null and value <> -9999 and abs(value) < 9e36")
    return r.join(v, "code").groupBy("code", "level_hpa").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


PROFILE = "with a as (select sounding_id, unnest(soundings) s, generate_subscripts(soundings, 1) - 1 ascent_no from soundings)"


@query(PROFILE + " select sounding_id, ascent_no, chunk_no, len(x) n, list_sum(list_transform(x, lambda v: coalesce(v, -32768)::bigint))::bigint total from (select sounding_id, ascent_no, unnest([s.p, s.t, s.z]) x, unnest([0, 1, 2]) chunk_no from a) where len(x) > 0")
def src_container_round_trip(spark, folder):
    """SRC-13, SRC-14, VER-01: profiles packed as chunks of a container and read back, checksums and offsets verified."""
    a = table(spark, folder, "soundings").select("sounding_id", F.posexplode("soundings").alias("ascent_no", "s")).select("sounding_id", "ascent_no", *(F.transform(f"s.{c}", lambda v: F.coalesce(v, F.lit(-32768))).alias(c) for c in ("p", "t", "z")))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            whole = [[np.asarray(x if x is not None else [], "<i4").tobytes() for x in r] for r in zip(b["p"], b["t"], b["z"], strict=True)]
            yield pd.DataFrame({"sounding_id": b["sounding_id"], "ascent_no": b["ascent_no"], "content": container.pack_all(whole)})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            spans = [(i, n, k, c[at : at + size], crc) for i, n, c in zip(b["sounding_id"], b["ascent_no"], b["content"], strict=True) for k, (at, size, crc) in enumerate(container.index(c))]
            rows = []
            for (i, n, k, _, _), c in zip(spans, container.chunks_of([s[3] for s in spans], [s[4] for s in spans]), strict=True):
                x = np.frombuffer(c, "<i4")
                if len(x):
                    rows.append((i, n, k, len(x), int(x.sum(dtype=np.int64))))
            yield pd.DataFrame(rows, columns=["sounding_id", "ascent_no", "chunk_no", "n", "total"])

    held = written(a.mapInPandas(make, "sounding_id long, ascent_no int, content binary"))
    return held.mapInPandas(read, "sounding_id long, ascent_no int, chunk_no int, n int, total long")


@query(PROFILE + ", c as (select sounding_id, ascent_no, unnest(s.p) p from a) select sounding_id, ascent_no, count(*) cells, round(sum(case when ((p % 256) + 256) % 256 < 250 then 0.5 * (((p % 256) + 256) % 256) - 10 end), 4)::double total from c group by all")
def src_plane_decode(spark, folder):
    """SRC-15, PRJ-01: planes of codes, compressed as differences, decoded and dequantised."""
    a = table(spark, folder, "soundings").select("sounding_id", F.posexplode("soundings").alias("ascent_no", "s")).where("size(s.p) > 0").select("sounding_id", "ascent_no", "s.p")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                codes = (np.asarray(r.p, np.int64) % 256).astype(np.uint8).reshape(-1, 1)
                back = container.decode_plane(container.encode_plane(codes), 1, len(codes)).ravel().astype(float)
                rows.append((r.sounding_id, r.ascent_no, len(back), float((0.5 * back[back < 250] - 10).sum()) if (back < 250).any() else None))
            yield pd.DataFrame(rows, columns=["sounding_id", "ascent_no", "cells", "total"])

    return a.mapInPandas(run, "sounding_id long, ascent_no int, cells long, total double").withColumn("total", F.round("total", 4))


@query("with d as (select doc_id, sha256(coalesce(text, '')) h from documents), s as (select doc_id, case when doc_id % 7 = 0 then 'x' else h end h from d where doc_id % 13 <> 0) select d.doc_id, case when s.doc_id is null then 'write' when s.h = d.h then 'skip' else 'conflict' end as \"action\" from d left join s using (doc_id)")
def snk_store_actions(spark, folder):
    """SNK-04: what a content-addressed copy does: write, skip, or refuse a conflict."""
    d = table(spark, folder, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    store = d.where("doc_id % 13 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.lit("x")).otherwise(F.col("h")).alias("h"))
    return stored(d, store, "doc_id", "h")


@query("select i * 8 + j chunk_no, i chunk_row, j chunk_col from range(ceil((select count(*) from variables) / 4.0)::bigint) a(i), range(8) b(j)")
def snk_chunk_keys(spark, folder):
    """SNK-05: the keys of a chunk grid from the shape of an array."""
    v = table(spark, folder, "variables").agg(F.ceil(F.count("*") / 4).alias("k"))
    x = v.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("chunk_row")).select("chunk_row", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("chunk_col"))
    return x.select((F.col("chunk_row") * 8 + F.col("chunk_col")).alias("chunk_no"), "chunk_row", "chunk_col")


@query()
def fn_crc32c(spark, folder):
    """FN-14: CRC-32C of texts. Tested with the published check value."""
    return table(spark, folder, "documents").select("doc_id", crc32c(F.col("text").cast("binary")).alias("crc"))


@query()
def ver_compression(spark, folder):
    """VER-03: compressed size of profiles raw and as differences, per source and column, the winner and the saving. Sizes depend on zlib: tested by decoding."""
    a = table(spark, folder, "soundings").select("source", F.explode("soundings").alias("s")).select("source", *(F.transform(f"s.{c}", lambda v: F.coalesce(v, F.lit(-32768))).alias(c) for c in ("p", "t", "z")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                for name in ("p", "t", "z"):
                    v = getattr(r, name)
                    if v is not None and len(v):
                        x = np.asarray(v, "<i4")
                        rows.append((r.source, name, len(zlib.compress(x.tobytes())), len(zlib.compress(np.diff(x, prepend=np.int32(0)).astype("<i4").tobytes()))))
            yield pd.DataFrame(rows, columns=["source", "field", "raw", "delta"])

    s = a.mapInPandas(run, "source string, field string, raw long, delta long").groupBy("source", "field").agg(F.sum("raw").alias("raw"), F.sum("delta").alias("delta"))
    return s.withColumn("winner", F.when(F.col("delta") < F.col("raw"), "delta").otherwise("raw")).withColumn("saving", F.round(1 - F.least("raw", "delta") / F.col("raw"), 6))


@query("""with r as (select raw_id, sha1(payload) h, case when raw_id % 5 = 0 then 'x' || payload else payload end back, payload from raw_records where payload is not null)
 select raw_id, case when raw_id % 7 = 0 then 'NOT COMPARED' when sha1(back) = h then 'identical' when raw_id % 5 = 0 then 'expected difference' else 'unexpected difference' end verdict from r""")
def ver_identity(spark, folder):
    """VER-01: identity of copies; what wasn't compared is told apart from what passed."""
    r = table(spark, folder, "raw_records").where("payload is not null")
    back = F.when(F.col("raw_id") % 5 == 0, F.concat(F.lit("x"), "payload")).otherwise(F.col("payload"))
    v = F.when(F.col("raw_id") % 7 == 0, "NOT COMPARED").when(F.sha1(back) == F.sha1("payload"), "identical").when(F.col("raw_id") % 5 == 0, "expected difference").otherwise("unexpected difference")
    return r.select("raw_id", v.alias("verdict"))


@query("""with u as (select doc_id, unnest(regexp_extract_all(text, 'http://[a-z]+[.]example/(img|wx)/[0-9]+')) link from documents), k as (select distinct link from (select unnest(regexp_extract_all(text, 'http://[a-z]+[.]example/(img|wx)/[0-9]+')) link from documents where source = 'gustboard'))
 select link, count(*) n from u where link not in (select link from k) group by link""")
def ver_missing_references(spark, folder):
    """VER-05: references that a set of sources doesn't know, by an anti-join."""
    d = table(spark, folder, "documents").select("source", F.explode(F.regexp_extract_all("text", F.lit(r"http://[a-z]+[.]example/(img|wx)/[0-9]+"), 0)).alias("link"))
    return d.join(d.where("source = 'gustboard'").select("link").distinct(), "link", "left_anti").groupBy("link").agg(F.count("*").alias("n"))


@query("select raw_id, length(payload) received, try_cast(json_extract_string(payload, '$.n_bytes') as bigint) declared, case when json_extract_string(payload, '$.n_bytes') is null then 'undeclared' else 'declared' end state from raw_records where json_valid(payload)")
def ver_declared_lengths(spark, folder):
    """VER-06: declared against received lengths."""
    r = table(spark, folder, "raw_records").where(F.try_parse_json("payload").isNotNull())
    d = F.get_json_object("payload", "$.n_bytes")
    return r.select("raw_id", F.length("payload").alias("received"), d.try_cast("long").alias("declared"), F.when(d.isNull(), "undeclared").otherwise("declared").alias("state"))


@query("""with t as (select doc_id, unnest(regexp_extract_all(lower(text), '\\b[0-9a-h]{6,12}\\b')) tok from documents) select tok, count(*) n, count(distinct doc_id) docs from t where regexp_matches(tok, '[a-h]') and regexp_matches(tok, '[0-9]') group by tok""")
def fn_hex_tokens(spark, folder):
    """FN-16: tokens like digests, with a letter and a digit, so that dates don't count."""
    t = table(spark, folder, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\b[0-9a-h]{6,12}\b"), 0)).alias("tok")).where(F.col("tok").rlike("[a-h]") & F.col("tok").rlike("[0-9]"))
    return t.groupBy("tok").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("""with a as (select item_id, lower(regexp_replace(question, '\\s+', '', 'g')) q, suite s, lang from eval_items), b as (select item_id + 1 item_id, q, s, lang from a)
 select a.item_id, case when a.q is null or b.q is null then 'invalid' when a.q = b.q and a.s = b.s then 'same question' when a.s = b.s then 'changed question' else 'changed scope' end verdict from a join b using (item_id)""")
def ver_receivers(spark, folder):
    """VER-08: questions against the one before: same, changed question, changed scope, invalid; rules in order."""
    a = table(spark, folder, "eval_items").select("item_id", F.lower(F.regexp_replace("question", r"\s+", "")).alias("q"), F.col("suite").alias("s"))
    b = a.select((F.col("item_id") + 1).alias("item_id"), F.col("q").alias("q0"), F.col("s").alias("s0"))
    v = F.when(F.col("q").isNull() | F.col("q0").isNull(), "invalid").when((F.col("q") == F.col("q0")) & (F.col("s") == F.col("s0")), "same question").when(F.col("s") == F.col("s0"), "changed question").otherwise("changed scope")
    return a.join(b, "item_id").select("item_id", v.alias("verdict"))


@query("select item_id, suite not in ('skyquiz', 'logreason') unknown_suite, lang not in ('en', 'de') unknown_lang, count(*) over (partition by answer) > 1 shared_answer from eval_items")
def ver_closed_vocabularies(spark, folder):
    """VER-09: closed vocabularies and distinguishing fields."""
    e = table(spark, folder, "eval_items")
    n = e.groupBy("answer").agg(F.count("*").alias("k"))
    return e.join(n, "answer").select("item_id", (~F.col("suite").isin("skyquiz", "logreason")).alias("unknown_suite"), (~F.col("lang").isin("en", "de")).alias("unknown_lang"), (F.col("k") > 1).alias("shared_answer"))


@query("""with a as (select source, code, avg(value) filter (hour(valid_time) < 12) m0, avg(value) filter (hour(valid_time) >= 12) m1 from field_readings where value between 0 and 1e6 and source is not null group by all)
 select code, count(*) n, count(*) filter (m1 > m0) ups, count(*) filter (m1 < m0) downs from a where m0 is not null and m1 is not null group by code""")
def ver_sign_test(spark, folder):
    """VER-10: a sign test over paired channels."""
    h = F.hour("valid_time")
    a = table(spark, folder, "field_readings").where("value between 0 and 1e6 and source is not null").groupBy("source", "code").agg(F.avg(F.when(h < 12, F.col("value"))).alias("m0"), F.avg(F.when(h >= 12, F.col("value"))).alias("m1")).where("m0 is not null and m1 is not null")
    return a.groupBy("code").agg(F.count("*").alias("n"), F.count_if(F.col("m1") > F.col("m0")).alias("ups"), F.count_if(F.col("m1") < F.col("m0")).alias("downs"))
