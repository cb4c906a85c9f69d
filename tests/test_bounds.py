from __future__ import annotations

from hemiciclo.operators import limits, windows
from hemiciclo.plans import queries

SF = "/root/testdata/sf0.001"


def test_deputy_search_has_no_cap(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(limits, "ensure_at_most", lambda df, n: asked.append(n) or df)
    assert queries.QUERIES["deputy_search"](spark, SF).count() > 0 and not asked


def test_windows_without_a_bound(spark, monkeypatch):
    text = spark.createDataFrame([("ab" * 150,)], "t string")
    assert windows.char_windows(text, "t", size=2, overlap=0, most=None).count() == 150
    bounds, made = [], windows.char_windows
    monkeypatch.setattr(windows, "char_windows", lambda *a, **k: bounds.append(k["most"]) or made(*a, **k))
    assert queries.QUERIES["char_windows"](spark, SF).count() > 0 and bounds == [None]
