"""Places of names: what is found, and that not every word of a text is sorted or dealt out for a few names."""

import io
from contextlib import redirect_stdout

from weft.operators import names as nm


def test_places_without_a_window(spark):
    texts = [(1, 1, "(Ann Lee) met Bo-Bo, and Ann; Ann-Lee was Ann’s."), (1, 2, "Mary Ann Lee Ann"), (2, 1, "ÉAnn Anné -Ann Ann, Lee"), (2, 2, "..."), (3, 1, None)]
    units = spark.createDataFrame(texts, "doc long, sid long, text string")
    names = ["Ann", "Ann Lee", "Bo-Bo", "(Ann", "Mary Ann Lee", "..."]
    found = nm.places(units, spark.createDataFrame([(n,) for n in names], "name string"))
    wanted = set()
    for doc, sid, text in texts:
        for name in names[:-1]:  # a name without a letter is no name
            at = -1
            while text and (at := text.find(name, at + 1)) >= 0:
                before, after = text[at - 1 : at] if at else "", text[at + len(name) : at + len(name) + 2]
                if not (before and (before.isalnum() or before in "-_")) and not (after and (after[0].isalnum() or after[0] == "_" or (after[0] == "-" and after[1:].isupper()))):
                    wanted.add((doc, sid, name, at, at + len(name)))
    assert {tuple(r) for r in found.collect()} == wanted and len(wanted) > 6
    said = io.StringIO()
    with redirect_stdout(said):
        found.explain("simple")
    assert "Window" not in said.getvalue()


def test_words_that_are_no_names_are_not_dealt_out(spark, monkeypatch):
    """Of all runs of words those with a name's hash alone meet the names, and names are sent to no task whole."""
    seen, kept = [], nm.salted
    monkeypatch.setattr(nm, "salted", lambda rows, few, key, spread: seen.append(rows) or kept(rows, few, key, spread))
    text = " ".join(f"word{i}" for i in range(3000))
    units = spark.createDataFrame([(1, 1, f"{text} Ann Lee met Bob."), (1, 2, "Bob saw word7 word8.")], "doc long, sid long, text string")
    names = spark.createDataFrame([("Ann Lee",), ("Bob",), ("word7 word8",)], "name string")
    found = nm.places(units, names)
    assert sorted((r.sid, r.name) for r in found.collect()) == [(1, "Ann Lee"), (1, "Bob"), (1, "word7 word8"), (2, "Bob"), (2, "word7 word8")]
    assert 5 <= seen[0].count() < 30
    plan = found._jdf.queryExecution().toString()
    assert "strategy=merge" in plan or "SortMergeJoin" in plan
    monkeypatch.setattr(nm, "HASHES", 1)  # whatever else has the same bit
    assert sorted(nm.places(units, names).collect()) == sorted(found.collect())
