"""Random records full of edge cases, against plain loops over the rows."""

import random
from collections import defaultdict
from datetime import date, timedelta

import pytest
from fixtures import rows_of

from jabcheck.functions.labels import INTERVAL_BINS
from jabcheck.operators import crosssource
from jabcheck.operators.staging import session_staging
from jabcheck.plans.covid import flagged_with_active, report_tables
from jabcheck.sources import schemas
from jabcheck.study import UNMAPPED, covid_study, flu_study

STUDY = covid_study()
FLU = flu_study()


def near(rng, days):
    return rng.choice(days) + timedelta(days=rng.choice([-200, -30, -8, -7, -1, 0, 0, 0, 1, 6, 7, 29, 90, 180]))


@pytest.fixture(scope="module")
def records():
    rng = random.Random(20)
    borders = [*STUDY.campaign_starts, *STUDY.approvals.values(), date(1850, 1, 1)]
    raw = [name for _, name in STUDY.products[:20]] + [None, "no such product"]
    deaths = {p: near(rng, borders) for p in range(0, 40, 3)}
    events = []
    for _ in range(700):
        patient = rng.randrange(40)
        day = None if rng.random() < 0.03 else near(rng, borders)
        events += [(patient, day, rng.choice(raw), 40, deaths.get(patient))] * rng.choice([1, 1, 1, 1, 2, 3])
    periods = []
    for _ in range(70):
        start = None if rng.random() < 0.05 else near(rng, borders)
        end = None if start is None or rng.random() < 0.3 else start + timedelta(days=rng.choice([0, 1, 100, 2000]))
        periods.append((rng.randrange(40), start, end))
    return events, periods


def campaign_of(day, study):
    found = [c.label for c in study.campaigns if c.start <= day]
    return found[-1] if found else None


def loops(events, periods):
    labels = {raw: label for label, raw in STUDY.products}
    rows = [(p, d, labels.get(raw, UNMAPPED), death) for p, d, raw, _, death in events if d is not None]
    by_day = defaultdict(list)
    for p, d, product, _ in rows:
        by_day[p, d].append(product)
    flags, active = [], defaultdict(list)
    for p, d, product, death in rows:
        total, kinds = len(by_day[p, d]), len(set(by_day[p, d]))
        approved = STUDY.approvals.get(product)
        raised = {
            "flag_implausible_early_date": d < STUDY.first_possible,
            "flag_pre_rollout_date": STUDY.first_possible <= d < STUDY.start,
            "flag_unapproved_product": approved is None,
            "flag_product_before_approval": approved is not None and d < approved,
            "flag_same_day_multiple": total > 1,
            "flag_same_day_same_product": total > 1 and kinds == 1,
            "flag_same_day_mixed_product": total > 1 and kinds > 1,
        }
        flags += [(p, campaign_of(d, STUDY), product, flag) for flag, value in raised.items() if value]
        registered = any(q == p and s is not None and s <= d and (e is None or e >= d) for q, s, e in periods)
        if registered and (death is None or death >= d):
            active[campaign_of(d, STUDY)].append(p)
    gaps = []
    for p in {row[0] for row in rows}:
        days = sorted(
            d for (q, d), products in by_day.items()
            if q == p and len(products) == 1 and campaign_of(d, STUDY) not in (None, STUDY.campaigns[0].label)
        )
        for before, now in zip(days, days[1:], strict=False):
            length = (now - before).days
            name = next(n for n, a, b in INTERVAL_BINS if length >= a and (b is None or length <= b))
            campaigns = campaign_of(before, STUDY), campaign_of(now, STUDY)
            gaps.append((p, *campaigns, by_day[p, before][0], by_day[p, now][0], name))
    return flags, active, gaps


def stage(campaign):
    return "primary" if campaign in ("Pre-roll-out", "Primary series") else "booster"


def context(gap):
    pair = stage(gap[1]), stage(gap[2])
    if pair == ("booster", "booster"):
        return "within_booster_campaign" if gap[1] == gap[2] else "between_booster_campaigns"
    return {("primary", "primary"): "within_primary", ("primary", "booster"): "primary_to_booster"}[pair]


def counted(items, key):
    groups = defaultdict(list)
    for item in items:
        groups[key(item)].append(item[0])
    return {k: (len(v), len(set(v))) for k, v in groups.items()}


def test_covid_tables(spark, records):
    events, periods = records
    flags, active, gaps = loops(events, periods)
    flagged = flagged_with_active(
        spark.createDataFrame(events, schemas.COVID_EVENTS).repartition(3),
        spark.createDataFrame(periods, schemas.COVID_REGISTRATIONS),
        STUDY,
    ).cache()
    tables = {name: rows_of(table) for name, table in report_tables(flagged, STUDY, session_staging(spark)).items()}
    totals = (len(flags), len({f[0] for f in flags}))

    overall = counted(flags, lambda f: f[3])
    assert tables["count_overall_noninterval_flags"] == sorted((k, *v, *totals) for k, v in overall.items())

    by_campaign = counted(flags, lambda f: (f[1], f[3]))
    expected = {
        (*k, *v, len(set(active[k[0]])) or None, len(active[k[0]]) or None) for k, v in by_campaign.items()
    }
    assert set(tables["count_campaign_noninterval_flags"]) == expected
    assert len(tables["count_campaign_noninterval_flags"]) == len(expected)
    assert any(row[0] is None for row in expected) and any(row[4] for row in expected)

    by_product = counted(flags, lambda f: (f[2], f[3]))
    assert set(tables["count_product_noninterval_flags"]) == {(*k, *v, *totals) for k, v in by_product.items()}

    labels = {
        "count_interval_context": context,
        "count_interval_campaign_transition": lambda g: f"{g[1]} -> {g[2]}",
        "count_interval_product_transition": lambda g: f"{g[3]} -> {g[4]}",
    }
    all_gaps = (len(gaps), len({g[0] for g in gaps}))
    for name, label in labels.items():
        groups = counted(gaps, label)
        cells = counted(gaps, lambda g, label=label: (label(g), g[5]))
        assert set(tables[name]) == {(*k, *v, *groups[k[0]], *all_gaps) for k, v in cells.items()}
        assert len(tables[name]) == len(cells)


def test_date_agreement(spark):
    rng = random.Random(5)
    borders = [*FLU.campaign_starts, date(1850, 1, 1)]
    rows = [(rng.randrange(60), near(rng, borders), 1, rng.choice(["table", "drug", "snomed"])) for _ in range(900)]
    dates = defaultdict(lambda: defaultdict(set))
    for p, d, _, source in rows:
        dates[p, campaign_of(d, FLU)][source].add(d)

    def agree(found, other, within):
        if not found["table"] or not found[other]:
            return None
        return any(abs((a - b).days) <= within for a in found["table"] for b in found[other])

    expected = {
        (p, campaign, *[agree(found, other, within) for within in (0, 7) for other in ("drug", "snomed")])
        for (p, campaign), found in dates.items()
    }
    records = spark.createDataFrame(rows, "patient_id BIGINT, vax_date DATE, age INT, source STRING")
    agreed = crosssource.date_agreement(records, FLU)
    labels = FLU.campaign_labels
    got = {
        (r.patient_id, labels[r.campaign_rank - 1] if r.campaign_rank else None, *[r[m] for m in crosssource.MATCHES])
        for r in agreed.collect()
    }
    assert got == expected and {True, False, None} <= {row[2] for row in got}
