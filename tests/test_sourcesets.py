"""Sets of any number of sources against a test of every subset and of every pair of dates."""

import random
from collections import Counter
from dataclasses import replace
from datetime import date, timedelta
from itertools import combinations

import pytest

from jabcheck.operators import crosssource, sourcesets
from jabcheck.study import flu_study

NAMES = ("table", "drug", "snomed", "pharmacy")
STUDY = replace(flu_study(), threshold=0)


def records(names, n=700):
    rng = random.Random(len(names))
    days = [date(2019, 6, 1) + timedelta(days=i) for i in range(0, 1200, 3)]
    rows = [(rng.choice([None, *range(60)]), rng.choice(days), rng.choice(names)) for _ in range(n)]
    return rows + rows[:40] + [(7, days[5], names[0])] * 100


def frame(spark, rows):
    return spark.createDataFrame([(p, d, 40, s) for p, d, s in rows], "patient_id BIGINT, vax_date DATE, age INT, source STRING")


def campaign_of(day):
    found = [label for first, label in zip(STUDY.campaign_starts, STUDY.campaign_labels, strict=True) if day >= first]
    return found[-1] if found else None


def people_of(rows):
    people = {}
    for patient, day, source in rows:
        people.setdefault((patient, campaign_of(day)), {}).setdefault(source, set()).add(day)
    return people


@pytest.mark.parametrize("names", [NAMES, NAMES[:1], [f"s{i}" for i in range(11)]])
def test_every_subset(spark, names):
    rows = records(names)
    expected = Counter()
    for campaign in {campaign_of(d) for _, d, _ in rows}:
        sets = Counter(frozenset(held) for (_, c), held in people_of(rows).items() if c == campaign)
        for size in range(len(names) + 1):
            for chosen in combinations(names, size):
                inclusive = sum(n for held, n in sets.items() if held >= set(chosen))
                if inclusive:
                    label = " + ".join(chosen) or "any"
                    expected[campaign, label, size, sets[frozenset(chosen)], inclusive, sum(sets.values())] += 1
    got = sourcesets.intersection_table(frame(spark, rows), names, STUDY)
    assert Counter(map(tuple, got.collect())) == expected


def test_every_pair_of_dates(spark):
    rows, expected = records(NAMES), set()
    people = people_of(rows)
    for campaign in {campaign_of(d) for _, d, _ in rows}:
        for a, b in combinations(NAMES, 2):
            for within in (0, 3, 7):
                both = [h for (_, c), h in people.items() if c == campaign and a in h and b in h]
                near = [h for h in both if any(abs((x - y).days) <= within for x in h[a] for y in h[b])]
                expected.add((campaign, a, b, within, len(near), len(both)))
    got = sourcesets.pair_agreement(frame(spark, rows), NAMES, STUDY, (0, 3, 7))
    assert set(map(tuple, got.collect())) == expected


def test_three_sources_as_before(spark):
    """The general form gives the counts of the form for three fixed sources."""
    rows = records(crosssource.SOURCES)
    old = crosssource.combination_counts(crosssource.source_presence(frame(spark, rows), STUDY), STUDY)
    new = sourcesets.exclusive_counts(sourcesets.source_masks(frame(spark, rows), crosssource.SOURCES, STUDY), STUDY)
    bits = {(r.campaign_rank, r.table + 2 * r.drug + 4 * r.snomed): r.n for r in old.collect()}
    assert bits == {(r.campaign_rank, r.sources): r.n for r in new.collect()}


def test_the_highest_bit(spark):
    names = [f"s{i}" for i in range(sourcesets.MOST_SOURCES)]
    rows = [(1, date(2021, 9, 2), names[-1]), (1, date(2021, 9, 2), names[0])]
    got = sourcesets.intersection_table(frame(spark, rows), names, STUDY).collect()
    assert {(r.source_set, r.n_exclusive, r.n_inclusive) for r in got} == {
        ("any", 0, 1), ("s0", 0, 1), ("s61", 0, 1), ("s0 + s61", 1, 1)
    }


@pytest.mark.parametrize("source", ["other", None])
def test_unknown_sources_raise(spark, source):
    with pytest.raises(Exception, match="unknown source"):
        sourcesets.source_masks(frame(spark, [(1, date(2021, 9, 2), source)]), NAMES, STUDY).collect()


@pytest.mark.parametrize("names", [[], ["a", "a"], [f"s{i}" for i in range(63)]])
def test_names_are_checked(spark, names):
    with pytest.raises(ValueError, match="different sources"):
        sourcesets.source_bit(names)


def test_empty(spark):
    assert sourcesets.intersection_table(frame(spark, []), NAMES, STUDY).collect() == []
    assert sourcesets.pair_agreement(frame(spark, []), NAMES, STUDY, (0,)).collect() == []
