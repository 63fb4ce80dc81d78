from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from support import rows
from leeward import config, schemas
from leeward.functions.text import fold, numbers_in
from leeward.operators import audit, governance, search
from leeward.session import fresh_path, make_folder
from leeward.sources import files


def put(spark, name, text):
    root = fresh_path(spark, "files")
    make_folder(spark, root)
    path = f"{root}/{name}".replace("file:", "")
    with open(path, "w", encoding="utf-8") as handle:
        handle.write(text)
    return root


def document(unit="m/s", elevation=0.0):
    hourly = {name: [1.0 * i + 1, 2.0 * i + 1] for i, name in enumerate(schemas.HOURLY)}
    return json.dumps({"latitude": 54.79789, "longitude": 17.821783, "elevation": elevation, "req_lat": 54.81, "req_lon": 17.83,
                       "hourly_units": {"wind_speed_10m": unit}, "hourly": {"time": ["2020-01-01T00:00", "2020-01-01T01:00"], **hourly}})


def test_weather_files_and_unit_gate(spark):
    root = put(spark, "a.json", document())
    for name, text in (("b.json", document("km/h")), ("c.json", document().replace('"m/s"', "null"))):
        with open(root.replace("file:", "") + "/" + name, "w", encoding="utf-8") as handle:
            handle.write(text)
    ok, bad = files.gate_units(files.read_weather_files(spark, root))
    assert ok.count() == 1 and bad.count() == 2
    hours = files.read_meteo(spark, root)
    got = hours.orderBy("hour").collect()
    assert len(got) == 2 and got[0]["source_file"].endswith("a.json") and got[0]["ingest_timestamp"] is not None
    assert (got[1]["wind_speed_10m"], got[1]["precipitation"], got[1]["grid_lat"], got[1]["req_lat"]) == (1.0, 9.0, 54.79789, 54.81)
    assert hours.select(F.unix_seconds("hour")).distinct().count() == 2


def test_text_readers(spark):
    cities = files.read_cities(spark, put(spark, "c.tsv", "city_id\tname\taliases\tlat\tlon\tpopulation\n1\tLębork\tLebork,Lauenburg\t54.5\t17.7\t35000\n2\t福島市\tFukushima City\t37.7\t140.4\t280000\n"))
    keys = audit.city_aliases(cities, "name", "aliases")
    asked = spark.createDataFrame([("LEBORK",), ("Lębork ",), ("福島市",), ("fukushima city",), ("Atlantis",)], "city_alias string")
    assert [r.city_id for r in audit.resolve_alias(asked, keys).orderBy("city_id").collect()] == [None, 1, 1, 2, 2]
    term = files.read_source_term(spark, put(spark, "s.csv", "nuclide,hour,source_term_bq\nCs-137,2011-03-12T00:00:00,1e12\n"))
    assert rows(term, "nuclide", "source_term_bq") == [("Cs-137", 1e12)]
    assert files.read_measurements(spark, put(spark, "m.csv", "lat,lon,measured_at,dose_rate_usv_h\n37.4,141.0,2011-03-15T00:00:00,0.5\n")).count() == 1
    assert files.read_deposition(spark, put(spark, "d.csv", "lat,lon,sampled_at,medium,nuclide,kbq_m2\n37.4,141.0,2011-03-15T00:00:00,soil,Cs-137,12.5\n")).first().kbq_m2 == 12.5
    assert files.read_population(spark, put(spark, "p.csv", "x,y,people\n1,2,3\n")).first().people == 3.0
    feed = files.read_device_cdc(spark, put(spark, "f.json", '{"device_id":"a","seq":1,"op":"INSERT","firmware":"v1"}\n'))
    assert feed.schema == schemas.DEVICE_CHANGE and feed.count() == 1


def test_strict_path_refuses_other_columns(spark):
    good = spark.createDataFrame([], schemas.READING)
    assert "ingestion_path" in files.strict_ingest(good, schemas.READING, "direct").columns
    with pytest.raises(ValueError, match="detector_temp_c"):
        files.strict_ingest(good.withColumn("detector_temp_c", F.lit(1.0)), schemas.READING, "direct")


def test_settings_from_yaml(spark, tmp_path):
    path = tmp_path / "s.yaml"
    path.write_text("limits: {max_lag_minutes: 10}\nrun: {n_episodes: 20}\nthresholds:\n  - {threshold_id: t, measure: deposition, value: 5, nuclide: Cs-137}\n")
    s = config.load_settings(str(path))
    assert s.limits.max_lag_minutes == 10 and s.limits.wind_max == 45 and s.run.n_episodes == 20 and len(s.thresholds) == 1
    assert rows(files.threshold_dim(spark, s), "threshold_id", "value") == [("t", 5.0)]
    path.write_text("limits: {no_such: 1}\n")
    with pytest.raises(ValueError, match="no_such"):
        config.load_settings(str(path))


def test_row_filter_and_masks(spark):
    df = spark.createDataFrame([("a", "JP-07", 37.41, 1e9), ("b", "PL-22", 54.8, 2e9), ("c", None, 1.0, 1.0)],
                               "device_id string, jurisdiction_code string, lat double, source_term_bq double")
    policy = governance.default_policy(spark, ["JP-07", "PL-22"])
    seen = lambda groups: [r[0] for r in rows(governance.visible_rows(df, policy, groups), "device_id")]
    assert seen(["jur_JP-07"]) == ["a"] and seen([]) == [] and seen([governance.NATIONAL]) == ["a", "b", "c"]
    masked = governance.mask(df, "public_analyst", "s", 0.05).filter("jurisdiction_code = 'JP-07'").first()
    assert len(masked.device_id) == 64 and masked.source_term_bq is None and abs(masked.lat - 37.425) < 1e-9
    assert rows(governance.mask(df, "regulator"), "device_id") == [("a",), ("b",), ("c",)]


def test_answer_numbers_and_limits(spark):
    answers = spark.createDataFrame([(1, "12.5 percent within 50 km. Comparative tool, not a crisis forecast."), (2, "about 13"), (3, "none")],
                                    "answer_id long, answer string")
    results = spark.createDataFrame([(1, 12.5), (1, 50.0), (2, 12.0)], "answer_id long, value double")
    assert rows(audit.unsupported_numbers(answers, results), "answer_id", "number") == [(2, 13.0)]
    assert rows(audit.audited(answers, results), "answer_id", "verdict") == [(1, "accepted"), (2, "rejected"), (3, "accepted")]
    assert rows(audit.missing_limitation(answers), "answer_id") == [(2,), (3,)]


def test_intents_in_both_languages(spark):
    asked = ["How likely will X contaminate Y?", "Czy uwolnienie skazi Lębork?", "Co oznacza próg?", "What is the class, and how many people?", "Hello"]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "id long, question string")
    assert [r.intent for r in audit.intent(df).orderBy("id").collect()] == ["numbers", "numbers", "method", "mixed", "other"]


def test_refusal_counts_as_right_only_where_expected(spark):
    expected = spark.createDataFrame([(1, False, 5.0), (2, True, None), (3, False, 1.0), (4, True, None), (5, False, 2.0)],
                                     "question_id long, expects_refusal boolean, expected_value double")
    produced = spark.createDataFrame([(1, False, 5.0), (2, True, None), (3, True, None), (4, False, 9.0)],
                                     "question_id long, refused boolean, value double")
    assert [r.is_right for r in audit.eval_join(expected, produced).orderBy("question_id").collect()] == [True, True, False, False, False]


def test_chunks_cover_the_whole_text(spark):
    words = [f"w{i}" for i in range(1003)]
    df = spark.createDataFrame([(1, " \n".join(words)), (2, "one two"), (3, "  "), (4, None)], "doc_id long, text string")
    out = search.chunk(df, 100, 20)
    parts = [r.chunk.split(" ") for r in out.filter("doc_id = 1").orderBy("chunk_no").collect()]
    assert parts[0][-20:] == parts[1][:20] and parts[-1][-1] == "w1002" and {w for p in parts for w in p} == set(words)
    assert out.filter("doc_id = 2").count() == 1 and out.filter("doc_id > 2").count() == 0
    assert rows(out, "chunk_id") == rows(search.chunk(df.repartition(3), 100, 20), "chunk_id")


def test_knn_matches_brute_force_and_checks_its_batch(spark):
    import math
    vectors = {i: [math.sin(i * k + 1) for k in range(1, 9)] for i in range(300)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([("q1", vectors[5]), ("q2", vectors[77])], "query_id string, query_vector array<double>")
    for name, vector in (("q1", vectors[5]), ("q2", vectors[77])):
        scored = sorted(((-sum(a * b for a, b in zip(vector, v)), i) for i, v in vectors.items()))[:4]
        got = search.knn(queries, df, 4).filter(F.col("query_id") == name).orderBy("place").collect()
        assert [r.vec_id for r in got] == [i for _, i in scored]
    one, many = search.knn(queries, df, 4, block=1), search.knn(queries, df, 4)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_numbers_with_comma_and_sign(spark):
    texts = ["12,5 and 3.25", "1,000 of 12,345,678.5", "-4 or \u22127,5", "2011-03-14 5-10", "a-1 b 1,2,3", "", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(numbers_in(F.col("t"))).collect()]
    assert got == [[12.5, 3.25], [1000.0, 12345678.5], [-4.0, -7.5], [2011.0, 3.0, 14.0, 5.0, 10.0], [1.0, 1.2, 3.0], [], None]


def test_shared_alias_is_ambiguous(spark):
    cities = spark.createDataFrame([(1, "Alfa", "Ą"), (2, "Beta", "a,b"), (3, "beta", None)], "city_id long, city_name string, aliases string")
    asked = spark.createDataFrame([("ALFA",), (" a",), ("b",), ("BETA",), ("c",), (None,)], "city_alias string")
    got = {r.city_alias: (r.city_id, r.alias_status) for r in audit.resolve_alias(asked, audit.city_aliases(cities, aliases="aliases")).collect()}
    assert got == {"ALFA": (1, "found"), " a": (None, "ambiguous"), "b": (2, "found"), "BETA": (None, "ambiguous"), "c": (None, "unknown"),
                   None: (None, "unknown")}


def test_header_in_another_order_is_refused(spark):
    root = put(spark, "swapped.tsv", "name\tcity_id\taliases\tlat\tlon\tpopulation\nX\t1\ta\t54.5\t17.7\t35000\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_cities(spark, root).collect()


def test_folding(spark):
    df = spark.createDataFrame([(" Żółć ",)], "x string")
    assert df.select(fold(F.col("x"))).first()[0] == "zolc"


def test_every_landed_line_is_a_row_or_a_reject(spark):
    text = "lat,lon,measured_at,dose_rate_usv_h\n37.4,141.0,2011-03-15T00:00:00,0.5\nx,141.0,2011-03-15T00:00:00,0.5\n37.4,141.0\n37.4,141.0,,\n"
    good, bad = files.with_rejects(spark, put(spark, "m.csv", text), schemas.DOSE_POINT)
    assert [tuple(r) for r in good.select("lat", "dose_rate_usv_h").collect()] == [(37.4, 0.5), (37.4, None)]
    assert sorted(r.line for r in bad.collect()) == ["37.4,141.0", "x,141.0,2011-03-15T00:00:00,0.5"]
    assert good.columns == [*schemas.DOSE_POINT.fieldNames(), "source_file", "ingest_timestamp"] and bad.first().source_file.endswith("m.csv")
    feed = '{"device_id":"a","seq":1}\n{"device_id":"b","seq":"one"}\n{"device_id":\nno json\n'
    good, bad = files.with_rejects(spark, put(spark, "f.json", feed), schemas.DEVICE_CHANGE, None)
    assert [r.device_id for r in good.collect()] == ["a"] and bad.count() == 3
    with pytest.raises(Exception, match="header|Header|CSV"):
        files.with_rejects(spark, put(spark, "h.csv", "lon,lat,measured_at,dose_rate_usv_h\n1,2,,\n"), schemas.DOSE_POINT)
