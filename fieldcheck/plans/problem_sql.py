"""DuckDB SQL of the general problems' queries, written independently of the operators: plain joins, no cells, buckets or segments."""

from __future__ import annotations

from ..functions.units import QUANTITY_OF, SOUNDING_REMARKS, UNITS

METAR = """m0 as (select hist_id, nullif(upper(trim(icao)), '') icao, unnest(metars) m, generate_subscripts(metars, 1) - 1 item_no from station_history),
 m1 as (select hist_id, icao, item_no, m.t t, trim(m.time) x from m0),
 m2 as (select hist_id, icao, item_no, t, case when regexp_matches(x, '^[0-9]{8}T') then substr(x,1,4)||'-'||substr(x,5,2)||'-'||substr(x,7,2)||'T'||substr(x,10,2)||':'||substr(x,12,2)||':00'||substr(x,14)
  when regexp_matches(x, '^.{16}(Z|$)') then substr(x,1,16)||':00'||substr(x,17) else x end x from m1),
 metar as (select hist_id, icao, item_no, t, epoch_us(try_cast(case when regexp_matches(x, '(Z|[+-][0-9]{2}:[0-9]{2})$') then x else x || 'Z' end as timestamptz)) us from m2)"""
ASCENT = """a0 as (select sounding_id, nullif(upper(trim(icao)), '') icao, unnest(soundings) a, generate_subscripts(soundings, 1) - 1 item_no from soundings),
 ascent as (select sounding_id, icao, item_no, epoch_us(try_cast(case when regexp_matches(a.time, '^.{16}Z$') then substr(a.time, 1, 16) || ':00Z' else a.time end as timestamptz)) us from a0)"""
OBSERVED = "o as (select obs_id, nullif(upper(trim(icao)), '') icao, epoch_us(obstime) us from station_index)"

_words = ", ".join(f"('{q}', '{w}', '{u}')" for q, u, _, _, ws in UNITS for w in ws.split(" "))
_scales = ", ".join(f"('{q}', '{u}', {f!r}::double, {o!r}::double)" for q, u, f, o, _ in UNITS)
_quantities = ", ".join(f"('{u}', '{q}')" for u, q in QUANTITY_OF.items())
_plain = "regexp_replace(lower(translate({0}, '²³⁻¹º', '23-1°')), '\\s+|\\*\\*|\\^', '', 'g')"
_number = "'[-+]?[0-9]+(?:[.,][0-9]+)*(?:[eE][-+]?[0-9]+)?'"
READING = f"""words(q, w, u) as (values {_words}), quantities(tu, q) as (values {_quantities}), v as (select code, training_units, q, words.u target from variables join quantities on tu = training_units join words using (q) where w = {_plain.format('training_units')}),
 r0 as (select r.*, v.q, target, coalesce(case when not isnan(value) then value end, try_cast(replace(regexp_extract(value_text, {_number}), ',', '.') as double)) number,
  coalesce(unit, nullif(trim(regexp_extract(value_text, {_number} || '(.*)$', 1)), ''), nullif(regexp_extract(note, '(?:units: |given as |log sheet [0-9]+, |^\\(|\\[)([^\\])]+?)(?:, checked|\\] hand-read|\\))?$', 1), ''), nullif(regexp_extract(note, '^[a-z]+ in (.+)$', 1), '')) said from field_readings r join v using (code)),
 r1 as (select r0.*, w1.u stated from r0 left join words w1 on w1.q = r0.q and w1.w = {_plain.format('said')} where number is not null and number <> -9999 and abs(number) < 9e36),
 only_unit as (select source, code, min(stated) u, count(distinct stated) k from r1 group by source, code),
 r as (select r1.*, coalesce(stated, only_unit.u) recorded from r1 join only_unit using (source, code))"""
_remark = "case " + " ".join(f"when regexp_matches(remarks, '(?i){p}') then '{u}'" for p, u in SOUNDING_REMARKS) + " end"
SOUNDING = f"""s0 as (select sounding_id, source, {_remark} stated, len(list_filter(flatten(list_transform(soundings, lambda x: coalesce(x.t, []))), lambda t: t is not null and t <> -32768)) n from soundings),
 s1 as (select source, min(stated) u from s0 where n > 0 group by source), s as (select s0.*, coalesce(stated, u, 'cK') recorded from s0 join s1 using (source) where n > 0)"""
P3 = f"with {READING}, {SOUNDING} select 'reading' src, reading_id record_id from r where recorded <> target union all select 'sounding', sounding_id from s where recorded <> 'cK'"
P3_CONVERTED = f"""with {READING}, scales(q, u, f, o) as (values {_scales}) select reading_id, code, source, recorded recorded_unit, target unit,
 ((((number * a.f + a.o) / case when recorded in ('J m-2', 'kJ m-2') and target not in ('J m-2', 'kJ m-2') then accum_hours * 3600.0 else 1 end) - b.o) / b.f) as "value"
 from r join scales a on a.q = r.q and a.u = recorded join scales b on b.q = r.q and b.u = target"""
P3_CONVERTED_ALL = f"""with {READING}, {SOUNDING}, scales(q, u, f, o) as (values {_scales}),
 su as (select coalesce(source, '?') source, min(stated) u from s0 where n > 0 group by all),
 sr as (select sounding_id, su.source, coalesce(stated, u, 'cK') recorded from s0 join su on su.source = coalesce(s0.source, '?') where n > 0),
 sa as (select sounding_id, unnest(soundings) a, generate_subscripts(soundings, 1) - 1 ascent_no from soundings),
 sl as (select sounding_id, ascent_no, unnest(a.t) t, generate_subscripts(a.t, 1) - 1 level_no from sa)
 select 'reading' src, reading_id record_id, -1 ascent_no, -1 level_no, code, coalesce(source, '?') source, recorded recorded_unit, target unit,
 ((((number * a.f + a.o) / case when recorded in ('J m-2', 'kJ m-2') and target not in ('J m-2', 'kJ m-2') then accum_hours * 3600.0 else 1 end) - b.o) / b.f) as "value"
 from r join scales a on a.q = r.q and a.u = recorded join scales b on b.q = r.q and b.u = target
 union all select 'sounding', sounding_id, ascent_no, level_no, 't', source, recorded, 'K', t * f + o from sl join sr using (sounding_id) join scales on q = 'temperature' and scales.u = recorded where t is not null and t <> -32768"""

_km = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2))))"
_wrap = "((({0} + 180) % 360 + 360) % 360 - 180)"
P4 = f"""with st as (select distinct nullif(upper(trim(icao)), '') icao, lat, {_wrap.format('lon')} lon from stations where lat between -90 and 90 and lon between -180 and 360 and not (lat = 0 and lon = 0) and icao is not null),
 ar as (select area_id, kind, {_wrap.format('west')} west, {_wrap.format('east')} east, south, north, clat, clon, radius_km, ring, len(ring) n from area_boxes),
 hit as (select distinct icao, area_id from st, ar where case kind when 'box' then lat >= south and lat < north and case when west <= east then lon >= west and lon < east else lon >= west or lon < east end
  when 'disc' then {_km.format('lat', 'lon', 'clat', 'clon')} <= radius_km
  else list_sum(list_transform(range(1, n + 1), lambda i: ((ring[i].lat > lat) <> (ring[i % n + 1].lat > lat) and lon < ring[i].lon + (ring[i % n + 1].lon - ring[i].lon) * (lat - ring[i].lat) / nullif(ring[i % n + 1].lat - ring[i].lat, 0))::int)) % 2 = 1 end)
 select distinct 'near' kind, a.icao key_a, b.icao key_b from st a join st b on a.icao < b.icao and {_km.format('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 3.0 union all select 'inside', icao, area_id from hit"""

P5 = """with a0 as (select sounding_id, unnest(soundings) a, generate_subscripts(soundings, 1) - 1 ascent_no from soundings),
 j as (select raw_id, coalesce(json_extract(payload, '$.data'), payload::json) d from raw_records where json_valid(payload)),
 s as (select raw_id, json_extract(d, '$.soundings') s, json_extract(d, '$.metars') m from j),
 ra as (select raw_id, unnest(l) a, generate_subscripts(l, 1) - 1 ascent_no from (select raw_id, case json_type(s) when 'OBJECT' then [s] when 'ARRAY' then s::json[] end l from s)),
 rl as (select raw_id, ascent_no, case when json_type(json_extract(a, '$.levels')) = 'OBJECT' then 1 when json_type(json_extract(a, '$.levels')) = 'ARRAY' then json_array_length(a, '$.levels')
  else greatest(coalesce(json_array_length(a, '$.p'), 0), coalesce(json_array_length(a, '$.t'), 0), coalesce(json_array_length(a, '$.td'), 0), coalesce(json_array_length(a, '$.z'), 0), coalesce(json_array_length(a, '$.sig'), 0)) end n from ra where json_type(a) = 'OBJECT'),
 rm as (select raw_id, case json_type(m) when 'OBJECT' then 1 when 'ARRAY' then json_array_length(m) end n from s)
 select 'soundings' src, sounding_id record_id, ascent_no, unnest(range(greatest(coalesce(len(a.p), 0), coalesce(len(a.t), 0), coalesce(len(a.td), 0), coalesce(len(a.z), 0), coalesce(len(a.sig), 0)))) item_no from a0
 union all select 'station_history', hist_id, -1, unnest(range(len(metars))) from station_history
 union all select 'raw_records', raw_id, ascent_no, unnest(range(n::bigint)) from rl union all select 'raw_records', raw_id, -1, unnest(range(n::bigint)) from rm"""

P7 = f"""with {METAR}, g as (select distinct icao, us // 3600000000 h from metar where icao is not null and us is not null and t is not null and not isnan(t)),
 d as (select distinct icao, h // 24 d from g), need as (select icao, d * 24 + k h from d, range(24) r(k))
 select need.icao, strftime(make_timestamp(need.h * 3600000000), '%Y-%m-%dT%H') as "hour" from need left join g on g.icao = need.icao and g.h = need.h where g.h is null"""

_RAW = """j as (select raw_id, coalesce(json_extract(payload, '$.data'), payload::json) d from raw_records where json_valid(payload)),
 s as (select raw_id, json_extract(d, '$.soundings') s, json_extract(d, '$.metars') m from j),
 ra as (select raw_id, unnest(l) a, generate_subscripts(l, 1) - 1 ascent_no from (select raw_id, case json_type(s) when 'OBJECT' then [s] when 'ARRAY' then s::json[] end l from s)),
 rm as (select raw_id, unnest(l) a, generate_subscripts(l, 1) - 1 item_no from (select raw_id, case json_type(m) when 'OBJECT' then [m] when 'ARRAY' then m::json[] end l from s))"""
_numbers = ", ".join(f"try_cast(a->>'{c}' as double) {c}" for c in ("t", "td", "qnh", "slp"))
P5_METARS = f"""with {_RAW}, h as (select hist_id, unnest(metars) m, generate_subscripts(metars, 1) - 1 item_no from station_history)
 select 'station_history' src, hist_id record_id, item_no, m.time as "time", m.t t, m.td td, m.qnh qnh, m.slp slp from h where m is not null
 union all select 'raw_records', raw_id, item_no, a->>'time', {_numbers} from rm where json_type(a) = 'OBJECT'"""
P5_ASCENTS = f"""with {_RAW}, a0 as (select sounding_id, unnest(soundings) a, generate_subscripts(soundings, 1) - 1 ascent_no from soundings)
 select 'soundings' src, sounding_id record_id, ascent_no, a.time as "time", a.n n from a0 where a is not null union all select 'raw_records', raw_id, ascent_no, a->>'time', try_cast(a->>'n' as int) from ra where json_type(a) = 'OBJECT'"""
_LEVEL = ("p", "t", "td", "z", "sig")
_lens = ", ".join(f"coalesce(json_array_length(a, '$.{c}'), 0)" for c in _LEVEL)
P5_LEVELS = f"""with {_RAW}, a0 as (select sounding_id, unnest(soundings) a, generate_subscripts(soundings, 1) - 1 ascent_no from soundings),
 l0 as (select sounding_id, ascent_no, a, unnest(range(greatest({", ".join(f"coalesce(len(a.{c}), 0)" for c in _LEVEL)}))) i from a0),
 r0 as (select raw_id, ascent_no, a, json_type(json_extract(a, '$.levels')) kind from ra where json_type(a) = 'OBJECT'),
 r1 as (select *, unnest(range(case kind when 'OBJECT' then 1 when 'ARRAY' then json_array_length(a, '$.levels') else greatest({_lens}) end::bigint)) i from r0)
 select 'soundings' src, sounding_id record_id, ascent_no, i level_no, {", ".join(f"a.{c}[i + 1] {c}" for c in _LEVEL)} from l0
 union all select 'raw_records', raw_id, ascent_no, i, {", ".join(f"try_cast(json_extract_string(a, case kind when 'OBJECT' then '$.levels.{c}' when 'ARRAY' then '$.levels[' || i || '].{c}' else '$.{c}[' || i || ']' end) as int)" for c in _LEVEL)} from r1"""

P7_HOURLY = f"""with {METAR}, g as (select icao, us // 3600000000 h, avg(t) v from metar where icao is not null and us is not null and t is not null and not isnan(t) group by all),
 d as (select distinct icao, h // 24 d from g), need as (select icao, d * 24 + k h from d, range(24) r(k)),
 x as (select need.icao, need.h, a.h h0, a.v v0, b.h h1, b.v v1 from need asof left join g a on a.icao = need.icao and need.h >= a.h asof left join g b on b.icao = need.icao and need.h <= b.h)
 select icao, strftime(make_timestamp(h * 3600000000), '%Y-%m-%dT%H') as "hour", round(case when h0 = h then v0 when h1 - h0 <= 4 then v0 + (v1 - v0) * (h - h0) / (h1 - h0) end, 4) t, case when h0 = h then 'observed' when h1 - h0 <= 4 then 'interpolated' else 'missing' end state from x"""

ORACLE = {"p5_metars": P5_METARS, "p5_ascents": P5_ASCENTS, "p5_levels": P5_LEVELS, "p7_hourly": P7_HOURLY, "p3_found": P3, "p3_converted": P3_CONVERTED, "p3_converted_all": P3_CONVERTED_ALL, "p4_found": P4, "p5_found": P5, "p7_found": P7}
