"""Pairs named together against links that are pairs of one class."""

from weft.operators import names as nm


def test_classes_give_what_their_pairs_give_and_make_no_pair_of_their_own(spark):
    units = spark.createDataFrame([(u, w) for u in range(9) for w in range(7) if (u * w + u + w) % 3 != 1] + [(0, 0)], "unit long, who long")
    classes = spark.createDataFrame([(w, w % 3 if w != 4 else None) for w in range(12)], "who long, class int")  # one without a class, some never named
    links = classes.alias("x").join(classes.alias("y"), "class").selectExpr("x.who a", "y.who b").filter("a < b")
    want = nm.dial(nm.comentions(units, ["unit"]), links)
    got = nm.class_dial(units, ["unit"], classes)
    assert got.schema == want.schema and sorted(got.collect()) == sorted(want.collect()) and got.filter("linked > 0").count()
    none = nm.class_dial(units.limit(0), ["unit"], classes.limit(0))
    assert sorted(none.collect()) == sorted(nm.dial(nm.comentions(units.limit(0), ["unit"]), links.limit(0)).collect())


def test_units_are_dealt_out_by_their_pairs(spark, monkeypatch):
    units = spark.createDataFrame([(u, w) for u in range(40) for w in range(u % 9)], "unit long, who long")
    want = sorted(nm.comentions(units, ["unit"]).collect())
    monkeypatch.setattr(nm, "PAIRS", 50)
    dealt = nm._together(units, ["unit"])
    assert dealt.rdd.getNumPartitions() > 4 and sorted(nm.comentions(units, ["unit"]).collect()) == want
