from fieldcheck.llm.weather_queries import QUERIES
from fieldcheck.tables import entity, table


def test_p1_scope_and_key(spark, data):
    got = {(r.scope, r.key) for r in QUERIES["p1_percentiles"](spark, data).select("scope", "key").distinct().collect()}
    assert {s for s, _ in got} == {"station", "variable", "model", "region"}
    p = table(spark, data, "plane_ceiling").where("variable is not null and model is not null and region is not null and abs(median) < 9000").first()
    icao = table(spark, data, "station_index").where("icao is not null and abs(t) < 90").select(entity("icao").alias("icao")).first().icao
    assert {("station", icao), ("variable", p.variable), ("model", f"{p.model}|{p.variable}"), ("region", f"{p.region}|{p.variable}")} <= got
