"""Passes at the reference's depths, by brute force on tables smaller than these."""

import pytest

import __spark_entry__ as entry
from tessella.operators import features
from tessella.plans import catalogue
from tessella.plans.views import view

SF = "/root/testdata/sf0.001"


def grams(text):
    return {f" {w} "[i : i + n] for w in text.split() for n in (3, 4, 5) for i in range(len(w) + 3 - n) if n <= len(w) + 2}


def partners_of(records):
    """The pool records of its country that share a rare gram with a query, for records (id, country, text)."""
    found = {}
    records = [(e, c, grams(t)) for e, c, t in records]
    for country in {c for _, c, _ in records if c is not None}:
        mine = [(e, g) for e, c, g in records if c == country]
        df = {}
        for _, g in mine:
            for x in g:
                df[x] = df.get(x, 0) + 1
        rare = {x for x, n in df.items() if n <= max(catalogue.RARE[0] * len(mine), catalogue.RARE[1])}
        for q, g in mine:
            if q.startswith("S1-"):
                found[q] = {e for e, h in mine if not e.startswith("S1-") and g & h & rare}
    return found


@pytest.fixture(scope="module")
def partners(spark):
    return partners_of([(r.entity_id, r.country, f"{r.name} {r.address}") for r in view(spark, SF, "rec").collect()])


def test_entry_lists_all_partners(spark, partners):
    got = {r.s1_id: set(filter(None, r.ids.split(","))) for r in entry.entry(spark).collect()}
    small = [q for q, p in partners.items() if len(p) <= features.K1]
    assert max(len(partners[q]) for q in small) > 5
    assert {q: got[q] for q in small} == {q: partners[q] for q in small}
    assert all(len(got[q]) == features.K1 for q in partners if q not in small)


def test_pair_features_holds_all_partners(spark):
    """The record pass compares cleaned names and addresses."""
    s1, pool = catalogue._entities(spark, SF)
    partners = partners_of([(r.entity_id, r.country, f"{r.name_core or ''} {r.addr_core or ''}") for r in s1.unionByName(pool).collect()])
    got = {}
    for r in catalogue.pair_features(spark, SF).where("in_p1 = 1").select("s1_id", "cand_id").collect():
        got.setdefault(r.s1_id, set()).add(r.cand_id)
    small = [q for q, p in partners.items() if 0 < len(p) <= features.K1]
    assert small and {q: got[q] for q in small} == {q: partners[q] for q in small}
