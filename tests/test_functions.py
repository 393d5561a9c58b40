import random
import struct

from pyspark.sql import functions as F

from splitlane.functions.bodies import decode_config, state_text
from splitlane.functions.hashing import draw_below, draw_unit, feature_hash, text_hash
from splitlane.functions.identity import enrich_identity, merge_identity, project_identity
from splitlane.functions.ids import ip_number, ip_text, pad_id
from splitlane.functions.scores import (
    best_position,
    random_position,
    round_half_up,
    variation_position,
    visitor_key,
)
from splitlane.sources.tables import decode_finishes, decode_predicts, decode_starts


def jvm_hash(text):
    units = struct.unpack(f">{len(text.encode('utf-16-be')) // 2}H", text.encode("utf-16-be"))
    value = 0
    for unit in units:
        value = (value * 31 + unit) & 0xFFFFFFFF
    return value - 2**32 if value >= 2**31 else value


def test_text_hash_equals_the_jvm_hash(spark):
    draws = random.Random(3)
    alphabet = "aZ09 _-é猫😀𝄞ÿ￿"
    texts = ["", "None", "é", "a" * 5000, "x😀y"]
    texts += ["".join(draws.choices(alphabet, k=draws.randrange(40))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select("t", text_hash(F.col("t")).alias("h")).collect():
        assert r.h == jvm_hash(r.t), r.t


def test_missing_value_hashes_as_the_text_none(spark):
    rows = spark.createDataFrame([("None",), (None,)], "t string")
    hashes = [r.h for r in rows.select(feature_hash(F.col("t")).alias("h")).collect()]
    assert hashes == [2433880.0, 2433880.0]


def test_pad_id_keeps_long_ids_whole(spark):
    rows = spark.createDataFrame([("1",), ("a" * 24,), ("b" * 26,), ("",)], "t string")
    padded = [r.p for r in rows.select(pad_id(F.col("t")).alias("p")).collect()]
    assert padded == ["0" * 23 + "1", "a" * 24, "b" * 26, "0" * 24]


def test_addresses_go_both_ways_and_bad_ones_are_null(spark):
    rows = spark.createDataFrame([("10.0.1.255",), ("10.0.1",), ("10.0.1.256",), ("x.1.1.1",)], "t string")
    out = rows.select(ip_number(F.col("t")).alias("n"), ip_text(ip_number(F.col("t"))).alias("t2")).collect()
    assert [r.n for r in out] == [167772671, None, None, None]
    assert out[0].t2 == "10.0.1.255"


def test_merge_takes_the_right_value(spark):
    rows = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": "4"})], "l map<string,string>, r map<string,string>")
    assert rows.select(merge_identity(F.col("l"), F.col("r")).alias("m")).first().m == {
        "a": "1", "b": "3", "c": "4",
    }


def test_enrich_with_and_without_an_address(spark):
    rows = spark.createDataFrame(
        [({"ip": "own"}, 5, 167772161, "Town", None), ({"ip": "own"}, 6, None, None, None)],
        "i map<string,string>, t bigint, n bigint, city string, country string",
    )
    made = enrich_identity(F.col("i"), F.col("t"), F.col("n"), F.col("city"), F.col("country"))
    first, second = [r.m for r in rows.select(made.alias("m")).collect()]
    assert first == {"ip": "10.0.0.1", "userTs": "5", "city": "Town", "country": "<unknown>"}
    assert second == {"ip": "0.0.0.0", "userTs": "6"}


def test_projection_of_a_missing_value_is_empty(spark):
    rows = spark.createDataFrame([({"a": "1"},)], "i map<string,string>")
    assert tuple(rows.select(*project_identity(F.col("i"), ["a", "z"])).first()) == ("1", "")


def test_halves_round_upwards(spark):
    rows = spark.createDataFrame([(-0.5,), (0.5,), (0.49,), (1.5,), (-1.5,)], "s double")
    assert [r.p for r in rows.select(round_half_up(F.col("s")).alias("p")).collect()] == [
        0.0, 1.0, 0.0, 2.0, -1.0,
    ]


def test_last_position_of_a_repeated_variation_wins(spark):
    rows = spark.createDataFrame([([("a", "x"), ("b", "y"), ("a", "z")],)], "v array<struct<id:string,value:string>>")
    position = lambda i: variation_position(F.col("v"), F.lit(i))
    assert tuple(rows.select(position("a"), position("b"), position("c")).first()) == (2, 1, None)


def test_best_position_prefers_the_first_of_equals(spark):
    rows = spark.createDataFrame([([0.1, 0.7, 0.7],), ([0.9],)], "s array<double>")
    assert [r.p for r in rows.select(best_position(F.col("s")).alias("p")).collect()] == [1, 0]


def test_draws_are_even_and_sticky(spark):
    rows = spark.range(20000).select(
        draw_unit(F.col("id")).alias("u"), draw_below(F.lit(4), F.col("id")).alias("b")
    )
    stats = rows.agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(stats[0] - 0.5) < 0.01 and stats[1] >= 0 and stats[2] < 1
    assert all(abs(r["count"] - 5000) < 300 for r in rows.groupBy("b").count().collect())
    assert rows.exceptAll(rows).count() == 0


def test_blank_sessions_are_drawn_one_by_one(spark):
    rows = spark.range(2000).select(
        random_position(F.lit(2), visitor_key(F.lit(""), F.col("id"))).alias("blank"),
        random_position(F.lit(2), visitor_key(F.lit("s"), F.col("id"))).alias("same"),
    )
    counts = rows.agg(F.sum("blank"), F.countDistinct("same")).first()
    assert 800 < counts[0] < 1200 and counts[1] == 1


def request(spark, *bodies):
    rows = [(i, b) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "event_id bigint, body string")


def test_start_bodies(spark):
    good, bad = decode_starts(
        request(
            spark,
            '{"session":"s","variation":"7","identity":{"a":"b"},"timestamp":12.9,"extra":[1]}',
            '{"session":"s","variation":"7"}',
            '{"variation":"7"}',
            '{"session":"s","variation":null}',
            "nonsense",
            "",
            None,
        )
    )
    rows = sorted(good.collect(), key=lambda r: r.event_id)
    assert [(r.session, r.variation, r.identity, r.ts_ms, r.kind) for r in rows] == [
        ("s", "7".zfill(24), {"a": "b"}, 12, "Random"),
        ("s", "7".zfill(24), {}, 0, "Random"),
    ]
    assert {r.event_id: r.fault for r in bad.collect()} == {
        2: "no session", 3: "no variation", 4: "malformed", 5: "malformed", 6: "malformed",
    }


def test_predict_and_finish_bodies_default_everything(spark):
    bodies = request(spark, "{}", '{"session":"x","timestamp":3}', "[")
    predicts, bad = decode_predicts(bodies)
    assert sorted((r.session, r.ts_ms, r.identity) for r in predicts.collect()) == [("", 0, {}), ("x", 3, {})]
    assert [r.event_id for r in bad.collect()] == [2]
    finishes, _ = decode_finishes(bodies)
    assert sorted((r.session, r.ts_ms) for r in finishes.collect()) == [("", 0), ("x", 3)]


def test_config_bodies(spark):
    out = decode_config(
        request(
            spark,
            '{"variations":[{"id":"1","value":"a"}],"descriptors":[{"name":"n","categorical":true}]}',
            '{"variations":[{"id":"1"}],"descriptors":[]}',
            '{"variations":[]}',
        )
    ).orderBy("event_id").collect()
    assert [r.fault for r in out] == [None, "no variations", "no descriptors"]
    assert out[0].variations == [("1".zfill(24), "a")] and out[0].descriptors == [("n", True)]


def test_state_text_names_the_epoch(spark):
    rows = spark.createDataFrame([("Predicting", 5), ("NoData", None)], "s string, f bigint")
    texts = [r.t for r in rows.select(state_text(F.col("s"), F.col("f")).alias("t")).collect()]
    assert texts == ["Predicting({ Epoch: #5 })", "NoData"]
