"""Plain SQL for the registered queries, written from the definitions, not from the plans.

Runs on the raw tables. Each query is a list of named views followed by a SELECT.
"""

from __future__ import annotations

from jabcheck.checks import standin
from jabcheck.checks.queries import AGREE_WITHIN, CLUSTERED_CAMPAIGN, FOUR_SOURCES
from jabcheck.functions.draws import HIGH_MULTIPLIER, MODULUS, MULTIPLIER, SALT_STEP
from jabcheck.functions.labels import INTERVAL_BINS
from jabcheck.operators.perturb import (
    BEFORE_APPROVAL_DAYS,
    COMPLEX_REPEATS,
    EXTRA_DOSE_DAYS,
    EXTRA_DOSE_SHARE,
    FAULTS,
    MOVED_PER_BIN,
    OPEN_BIN_LAST_DAY,
    SALTS,
)
from jabcheck.sources.layout import campaign_days
from jabcheck.study import Study

COVID, FLU = standin.covid_study(), standin.flu_study()


def _values(rows, name: str, columns: str) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join(f"({', '.join(r)})" for r in rows) + ")"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _date(value) -> str:
    return f"DATE '{value}'"


def _campaigns(study: Study, name: str) -> str:
    starts = study.campaign_starts
    rows = []
    for number, campaign in enumerate(study.campaigns):
        last = number + 1 == len(starts)
        rows.append(
            (
                str(number + 1),
                _text(campaign.label),
                _date(campaign.start),
                "NULL::DATE" if last else _date(starts[number + 1]),
            )
        )
    return _values(rows, name, "campaign_rank, campaign, from_day, to_day")


def _on_campaign(day: str, name: str = "cc") -> str:
    return f"LEFT JOIN {name} ON {day} >= {name}.from_day AND ({name}.to_day IS NULL OR {day} < {name}.to_day)"


CC = _campaigns(COVID, "cc")
FC = _campaigns(FLU, "fc")
PRODUCTS = _values(
    [(_text(raw), _text(label), str(rank)) for rank, (label, raw) in enumerate(COVID.products, 1)],
    "products",
    "raw, label, product_rank",
)
APPROVALS = _values([(_text(label), _date(day)) for label, day in COVID.approvals.items()], "approvals", "label, day")
BINS = _values(
    [
        (str(n), _text(label), str(first), "1000000" if last is None else str(last))
        for n, (label, first, last) in enumerate(INTERVAL_BINS, 1)
    ],
    "bins",
    "bin_rank, bin, first, last",
)

PERSONS = """persons AS (
  SELECT c_custkey AS patient_id, (DATE '1930-01-01' + ((c_custkey * 7919) % 25000)::INT)::DATE AS born,
         CASE WHEN c_acctbal < 0 THEN DATE '2000-01-01' END AS death_date
  FROM customer)"""
VAX = """vax AS (
  SELECT l_orderkey, l_linenumber, o_custkey AS patient_id, l_shipdate::DATE AS vax_date, p_brand AS raw, l_linestatus
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
PERIODS = """periods AS (
  SELECT o_custkey AS patient_id, o_orderdate::DATE AS first_day,
         CASE WHEN o_orderkey % 1000 <> 0 THEN (o_orderdate::DATE + (o_orderkey % 60)::INT)::DATE END AS last_day
  FROM orders)"""
EVENTS = f"""events_ AS (
  SELECT v.*, coalesce(p.label, 'UNMAPPED') AS product, coalesce(p.product_rank, {COVID.unmapped_rank}) AS product_rank,
         cc.campaign, cc.campaign_rank, a.day AS approval_date
  FROM vax v LEFT JOIN products p ON v.raw = p.raw LEFT JOIN approvals a ON a.label = p.label
  {_on_campaign("v.vax_date")})"""
DAYS = """days AS (
  SELECT patient_id, vax_date, count(*) AS total_records_day, count(DISTINCT product) AS n_products_day
  FROM events_ GROUP BY ALL)"""
FLAGGED = f"""flagged AS (
  SELECT e.*, d.total_records_day, d.n_products_day,
    e.vax_date < {_date(COVID.first_possible)} AS flag_implausible_early_date,
    e.vax_date >= {_date(COVID.first_possible)} AND e.vax_date < {_date(COVID.start)} AS flag_pre_rollout_date,
    approval_date IS NULL AS flag_unapproved_product,
    CASE WHEN approval_date IS NOT NULL THEN e.vax_date < approval_date END AS flag_product_before_approval,
    total_records_day > 1 AS flag_same_day_multiple,
    total_records_day > 1 AND n_products_day = 1 AS flag_same_day_same_product,
    total_records_day > 1 AND n_products_day > 1 AS flag_same_day_mixed_product
  FROM events_ e JOIN days d USING (patient_id, vax_date))"""
LONG = """long AS (
  SELECT patient_id, vax_date, campaign, product, flag_type FROM (
    UNPIVOT (SELECT patient_id, vax_date, campaign, product, COLUMNS('^flag_') FROM flagged)
    ON COLUMNS('^flag_') INTO NAME flag_type VALUE flag_value)
  WHERE flag_value)"""
GAPS = f"""kept AS (
  SELECT * FROM flagged WHERE campaign_rank > 1 AND NOT flag_same_day_multiple),
lagged AS (
  SELECT *, lag(vax_date) OVER w AS prev_date, lag(product) OVER w AS prev_product,
    lag(campaign) OVER w AS prev_campaign
  FROM kept WINDOW w AS (PARTITION BY patient_id ORDER BY vax_date)),
staged AS (
  SELECT *, date_diff('day', prev_date, vax_date)::INT AS interval_days,
    CASE WHEN campaign IN ('Pre-roll-out', 'Primary series') THEN 'primary'
         WHEN regexp_matches(campaign, 'Spring|Autumn') THEN 'booster' END AS campaign_stage,
    CASE WHEN prev_campaign IN ('Pre-roll-out', 'Primary series') THEN 'primary'
         WHEN regexp_matches(prev_campaign, 'Spring|Autumn') THEN 'booster' END AS prev_campaign_stage
  FROM lagged WHERE prev_date IS NOT NULL),
gaps AS (
  SELECT s.*, bins.bin AS interval_bin, bins.bin_rank AS interval_bin_rank,
    CASE WHEN prev_campaign_stage = 'primary' AND campaign_stage = 'primary' THEN 'within_primary'
         WHEN prev_campaign_stage = 'primary' AND campaign_stage = 'booster' THEN 'primary_to_booster'
         WHEN prev_campaign_stage = 'booster' AND campaign_stage = 'booster' AND prev_campaign = campaign
           THEN 'within_booster_campaign'
         WHEN prev_campaign_stage = 'booster' AND campaign_stage = 'booster' THEN 'between_booster_campaigns'
    END AS interval_context,
    prev_campaign || ' -> ' || campaign AS campaign_transition_type,
    prev_product || ' -> ' || product AS product_transition_type
  FROM staged s LEFT JOIN bins ON interval_days BETWEEN bins.first AND bins.last)"""
ACTIVE = """active AS (
  SELECT v.patient_id, v.vax_date, v.raw, v.l_linestatus, p.death_date,
    (p.death_date IS NULL OR p.death_date >= v.vax_date) AND EXISTS (
      SELECT 1 FROM periods r WHERE r.patient_id = v.patient_id AND r.first_day <= v.vax_date
        AND (r.last_day IS NULL OR r.last_day >= v.vax_date)) AS is_active
  FROM vax v LEFT JOIN persons p USING (patient_id))"""

FLU_RAW = """flu AS (
  SELECT o_custkey AS patient_id, o_orderdate::DATE AS vax_date, 'table' AS source FROM orders
  UNION ALL
  SELECT o_custkey, l_shipdate::DATE, CASE l_returnflag WHEN 'R' THEN 'snomed' ELSE 'drug' END
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
FLU_CAMPAIGN = f"""flu_c AS (
  SELECT flu.*, fc.campaign, fc.campaign_rank FROM flu {_on_campaign("flu.vax_date", "fc")})"""
PRESENCE = """presence AS (
  SELECT patient_id, campaign, bool_or(source = 'table') AS "table", bool_or(source = 'drug') AS drug,
         bool_or(source = 'snomed') AS snomed
  FROM flu_c GROUP BY patient_id, campaign),
combos AS (
  SELECT *, CASE
      WHEN "table" AND NOT drug AND NOT snomed THEN 'table only'
      WHEN NOT "table" AND drug AND NOT snomed THEN 'drug only'
      WHEN NOT "table" AND NOT drug AND snomed THEN 'snomed only'
      WHEN "table" AND drug AND NOT snomed THEN 'table + drug'
      WHEN "table" AND NOT drug AND snomed THEN 'table + snomed'
      WHEN NOT "table" AND drug AND snomed THEN 'drug + snomed'
      ELSE 'table + drug + snomed' END AS source_combination
  FROM presence)"""


def _midpoint(x: str, to: int) -> str:
    return f"(CASE WHEN {x} = 0 THEN 0 ELSE ceil({x} / {to}::DOUBLE)::BIGINT * {to} - {to // 2} END)::BIGINT"


def _tenth(x: str) -> str:
    low, high = f"(floor({x} * 10) / 10.0::DOUBLE)", f"(ceil({x} * 10) / 10.0::DOUBLE)"
    return (
        f"(CASE WHEN {x} - {low} < {high} - {x} THEN {low} WHEN {x} - {low} > {high} - {x} THEN {high} "
        f"WHEN floor({x} * 10)::BIGINT % 2 = 0 THEN {low} ELSE {high} END)"
    )


def _number(x: str) -> str:
    return f"regexp_replace(({x})::VARCHAR, '\\.0$', '')"


UPSET = f"""upset AS (
  SELECT campaign, "table", drug, snomed, source_combination, {_midpoint("count(*)", 10)} AS n
  FROM combos GROUP BY ALL)"""
AGREED = """pairs AS (
  SELECT patient_id, campaign, vax_date, source FROM flu_c GROUP BY ALL),
agreed AS (
  SELECT p.patient_id, p.campaign,
    {answers}
  FROM presence p)"""
_ANSWER = """CASE WHEN p."table" AND p.{other} THEN EXISTS (
      SELECT 1 FROM pairs a JOIN pairs b
        ON a.patient_id = b.patient_id AND a.campaign IS NOT DISTINCT FROM b.campaign
      WHERE a.source = 'table' AND b.source = '{other}' AND a.patient_id = p.patient_id
        AND a.campaign IS NOT DISTINCT FROM p.campaign
        AND abs(date_diff('day', a.vax_date, b.vax_date)) <= {days}) END AS {name}"""
AGREED = AGREED.format(
    answers=",\n    ".join(
        _ANSWER.format(other=other, days=days, name=f"{prefix}_table_{other}")
        for days, prefix in ((0, "same_day"), (7, "within_7d"))
        for other in ("drug", "snomed")
    )
)
COMPARISONS = (
    ("same_day_table_drug", "Same day: Table vs Drug"),
    ("same_day_table_snomed", "Same day: Table vs SNOMED"),
    ("within_7d_table_drug", "Within 7 days: Table vs Drug"),
    ("within_7d_table_snomed", "Within 7 days: Table vs SNOMED"),
)


def _sql(select: str, *views: str) -> str:
    return (f"WITH {', '.join(views)}\n" if views else "") + select


_EVENTS = (CC, PRODUCTS, APPROVALS, VAX, EVENTS)
_FLAGGED = (*_EVENTS, DAYS, FLAGGED)
_LONG = (*_FLAGGED, LONG)
_GAPS = (BINS, *_FLAGGED, GAPS)
_FLU = (FC, FLU_RAW, FLU_CAMPAIGN)
_PRESENCE = (*_FLU, PRESENCE)


def _age(born: str, day: str) -> str:
    return (
        f"(year({day}) - year({born}) - (CASE WHEN month({day}) * 100 + day({day}) < "
        f"month({born}) * 100 + day({born}) THEN 1 ELSE 0 END))::INT"
    )


_FLAG_COUNTS = "count(*) AS n_records, count(DISTINCT patient_id) AS n_patients"
_TOTALS = """(SELECT count(*) FROM {t}) AS denom_records_total,
  (SELECT count(DISTINCT patient_id) FROM {t}) AS denom_patients_total"""


def _interval_table(column: str) -> str:
    return _sql(
        f"""SELECT t.*, g.denom_records_group, g.denom_patients_group, {_TOTALS.format(t="gaps")}
FROM (SELECT {column}, interval_bin, {_FLAG_COUNTS} FROM gaps GROUP BY ALL) t
JOIN (SELECT {column}, count(*) AS denom_records_group, count(DISTINCT patient_id) AS denom_patients_group
      FROM gaps GROUP BY ALL) g ON t.{column} IS NOT DISTINCT FROM g.{column}""",
        *_GAPS,
    )


def _rounded(sql: str, keys: list[str], counts: list[str]) -> str:
    columns = [*keys, *[f"{_midpoint(c, 10)} AS {c}_midpoint6" for c in counts]]
    return f"SELECT {', '.join(columns)} FROM ({sql})"


# --- fault injection: the same arithmetic and the same ranks, as SQL over one global order


def _draw(key: str, salt: str) -> str:
    s = SALTS[salt]
    halves = f"({key}) % {MODULUS} * {MULTIPLIER} + (({key}) >> 31) % {MODULUS} * {HIGH_MULTIPLIER}"
    first = f"(({halves} + {s * SALT_STEP + 1}) % {MODULUS})"
    return f"((({first} * {first} + {s * HIGH_MULTIPLIER + 11}) % {MODULUS}) * {MULTIPLIER} + 7) % {MODULUS}"


def _below(key: str, salt: str, first: int, last: int) -> str:
    return f"({first} + (({_draw(key, salt)}) % {last - first + 1}))::INT"


def _pick(position: str, names: list[str]) -> str:
    return "CASE " + position + " " + " ".join(f"WHEN {n} THEN {_text(v)}" for n, v in enumerate(names, 1)) + " END"


RAW = [raw for _, raw in COVID.products]
UNAPPROVED = [raw for label, raw in COVID.products if label not in COVID.approvals]

KEYED = f"""keyed AS (
  SELECT o_orderkey AS row_key, o_custkey AS patient_id, o_orderdate::DATE AS vax_date,
         'Brand#' || (o_orderkey % 25 + 1) AS vax_product, {_age("born", "o_orderdate")} AS age
  FROM orders JOIN persons ON o_custkey = patient_id)"""


def _reaged(source: str, target: str, order: str, columns: str) -> str:
    shifted = f"ref_age + {_age('ref_date', 'vax_date')}"
    return f"""{target} AS (
  SELECT {columns}, CASE WHEN {shifted} IS NOT NULL THEN greatest(0, {shifted}) END::INT AS age
  FROM (SELECT *, first_value(vax_date) OVER w AS ref_date, first_value(age) OVER w AS ref_age FROM {source}
        WINDOW w AS (PARTITION BY patient_id ORDER BY vax_date, {order})))"""


def _expanded(source: str, target: str) -> str:
    return f"""{target}_persons AS (
  SELECT patient_id, row_number() OVER (ORDER BY {_draw("patient_id", "expand_patient")}, patient_id) AS place
  FROM (SELECT DISTINCT patient_id FROM {source})),
{target}_rows AS (
  SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY {_draw("row_key", "expand_row")}, row_key) AS rn
  FROM {source}),
{target} AS (
  SELECT row_key * 2 AS row_key, patient_id, vax_date, vax_product, age FROM {source}
  UNION ALL
  SELECT row_key * 2 + 1, patient_id,
    (vax_date + {_below("row_key", "expand_days", *EXTRA_DOSE_DAYS)})::DATE, vax_product, age
  FROM {target}_rows JOIN {target}_persons USING (patient_id)
  WHERE rn = 1 AND place <= (SELECT round_even(count(*) * {EXTRA_DOSE_SHARE}::DOUBLE, 0) FROM {target}_persons))"""


def _faulted(source: str, target: str) -> str:
    sizes, borders = [], []
    for name, rate, least in FAULTS:
        sizes.append(f"greatest({least}, floor(total * {rate}::DOUBLE)::BIGINT)")
        borders.append((name, " + ".join(sizes)))
    fault = "CASE " + " ".join(f"WHEN place < {border} THEN '{name}'" for name, border in borders) + " END"
    early_days = (COVID.first_possible - COVID.early_faults_from).days
    pre_days = (COVID.start - COVID.first_possible).days
    n = len(RAW)
    drawn = f"(({_draw('row_key', 'fault_product')}) % ({n} - CASE WHEN level > 0 THEN 1 ELSE 0 END) + 1)"
    last_repeat = COMPLEX_REPEATS[1]
    return f"""{target}_placed AS (
  SELECT *, row_number() OVER (ORDER BY {_draw("row_key", "fault_class")}, row_key) - 1 AS place,
    count(*) OVER () AS total FROM {source}),
{target}_classed AS (
  SELECT p.*, {fault} AS fault, coalesce(d.product_rank, 0) AS level, a.day AS approved_on
  FROM {target}_placed p LEFT JOIN products d ON d.raw = p.vax_product LEFT JOIN approvals a ON a.label = d.label),
{target}_changed AS (
  SELECT row_key, patient_id, age, fault, vax_product AS old_product,
    CASE WHEN fault = 'early_date'
         THEN ({_date(COVID.early_faults_from)} + {_below("row_key", "fault_date", 0, early_days - 1)})::DATE
         WHEN fault = 'pre_rollout_date'
         THEN ({_date(COVID.first_possible)} + {_below("row_key", "fault_date", 0, pre_days - 1)})::DATE
         WHEN fault = 'before_approval' AND approved_on IS NOT NULL
         THEN (approved_on - {_below("row_key", "fault_date", *BEFORE_APPROVAL_DAYS)})::DATE
         ELSE vax_date END AS vax_date,
    CASE WHEN fault = 'unapproved_product'
         THEN {_pick(f"(({_draw('row_key', 'fault_product')}) % {len(UNAPPROVED)} + 1)", UNAPPROVED)}
         ELSE vax_product END AS vax_product,
    {_pick(f"({drawn} + CASE WHEN level > 0 AND {drawn} >= level THEN 1 ELSE 0 END)", RAW)} AS other_product,
    {_below("row_key", "fault_repeats", *COMPLEX_REPEATS)} AS repeats
  FROM {target}_classed),
{target} AS (
  SELECT row_key, patient_id, age, vax_date, fault, 0 AS copy_no, vax_product FROM {target}_changed
  UNION ALL
  SELECT row_key, patient_id, age, vax_date, fault, 1, old_product FROM {target}_changed
  WHERE fault = 'same_day_same_product'
  UNION ALL
  SELECT row_key, patient_id, age, vax_date, fault, 1, other_product FROM {target}_changed
  WHERE fault = 'same_day_mixed_product'
  UNION ALL
  SELECT row_key, patient_id, age, vax_date, fault, i::INT, old_product
  FROM {target}_changed, range(1, {last_repeat + 1}) t(i) WHERE fault = 'same_day_complex' AND i <= repeats
  UNION ALL
  SELECT row_key, patient_id, age, vax_date, fault, repeats + 1, other_product FROM {target}_changed
  WHERE fault = 'same_day_complex')"""


def _moved(source: str, target: str) -> str:
    n_bins = len(INTERVAL_BINS)
    distance = "CASE bin " + " ".join(
        f"WHEN {n} THEN {_below('key', 'interval_days', first, last or OPEN_BIN_LAST_DAY)}"
        for n, (_, first, last) in enumerate(INTERVAL_BINS)
    )
    return f"""{target}_days AS (
  SELECT patient_id, vax_date, count(*) AS n, min(row_key) AS row_key, min(copy_no) AS copy_no
  FROM {source} GROUP BY patient_id, vax_date),
{target}_lagged AS (
  SELECT *, lag(vax_date) OVER w AS prev_date, lag(n) OVER w AS prev_n FROM {target}_days
  WINDOW w AS (PARTITION BY patient_id ORDER BY vax_date)),
{target}_eligible AS (
  SELECT *, row_key * 8 + copy_no AS key FROM {target}_lagged WHERE n = 1 AND prev_n = 1),
{target}_ranked AS (
  SELECT *, row_number() OVER (ORDER BY {_draw("key", "interval_row")}, key) - 1 AS place,
    least(count(*) OVER () // {n_bins}, {MOVED_PER_BIN}) AS per_bin
  FROM {target}_eligible),
{target}_moves AS (
  SELECT row_key, copy_no, (prev_date + {distance} END)::DATE AS new_date
  FROM (SELECT *, place // per_bin AS bin FROM {target}_ranked WHERE place < per_bin * {n_bins})),
{target}_applied AS (
  SELECT s.* EXCLUDE (vax_date), coalesce(m.new_date, s.vax_date) AS vax_date
  FROM {source} s LEFT JOIN {target}_moves m USING (row_key, copy_no)),
{_reaged(f"{target}_applied", target, "row_key, copy_no",
         "row_key, patient_id, vax_date, fault, copy_no, vax_product")}"""


def _injection() -> dict[str, str]:
    base = (PERSONS, KEYED)
    dims = (PRODUCTS, APPROVALS)
    columns = "row_key, patient_id, vax_date, vax_product, age"
    faulted = f"{columns}, fault, copy_no"
    return {
        "age_shift": _sql(
            f"SELECT {columns} FROM done",
            *base,
            _reaged("keyed", "done", "row_key", "row_key, patient_id, vax_date, vax_product"),
        ),
        "inject_expand": _sql(f"SELECT {columns} FROM done", *base, _expanded("keyed", "done")),
        "inject_faults": _sql(f"SELECT {faulted} FROM done", *base, *dims, _faulted("keyed", "done")),
        "inject_intervals": _sql(
            f"SELECT {faulted} FROM done", *base, *dims, _faulted("keyed", "bad"), _moved("bad", "done")
        ),
        "inject_all": _sql(
            f"SELECT {faulted} FROM done",
            *base,
            *dims,
            _expanded("keyed", "more"),
            _faulted("more", "bad"),
            _moved("bad", "done"),
        ),
    }


def _windows() -> str:
    """Records of each campaign up to its early and primary milestones and in all, from the calendar's dates."""
    rows = [(_text(c.label), _date(c.start), _date(c.early_milestone), _date(c.primary_milestone)) for c in FLU.campaigns]
    return _sql(
        """SELECT campaign, source, count(*) FILTER (WHERE vax_date <= early) AS n_to_early,
  count(*) FILTER (WHERE vax_date <= main) AS n_to_primary, count(*) AS n_records
FROM flu_c JOIN cal ON campaign = label GROUP BY campaign, source""",
        *_FLU,
        _values(rows, "cal", "label, first_day, early, main"),
    )


def _tables() -> dict[str, str]:
    totals = _TOTALS.format(t="long")
    tables = {
        "table1_overall_flags": _sql(
            f"SELECT flag_type, {_FLAG_COUNTS}, {totals} FROM long GROUP BY flag_type", *_LONG
        ),
        "table2_campaign_flags": _sql(
            f"""SELECT t.*, d.denom_patients_group, d.denom_records_group
FROM (SELECT campaign, flag_type, {_FLAG_COUNTS} FROM long GROUP BY ALL) t
LEFT JOIN (SELECT campaign, count(*) AS denom_records_group, count(DISTINCT patient_id) AS denom_patients_group
           FROM active {_on_campaign("active.vax_date")} WHERE is_active GROUP BY campaign) d
  ON t.campaign IS NOT DISTINCT FROM d.campaign""",
            PERSONS,
            PERIODS,
            *_LONG,
            ACTIVE,
        ),
        "table3_product_flags": _sql(
            f"SELECT product AS vax_product, flag_type, {_FLAG_COUNTS}, {totals} FROM long GROUP BY ALL", *_LONG
        ),
        "table4_interval_context": _interval_table("interval_context"),
        "table5_campaign_transition": _interval_table("campaign_transition_type"),
        "table6_product_transition": _interval_table("product_transition_type"),
    }
    counts, totals_ = ["n_records", "n_patients"], ["denom_records_total", "denom_patients_total"]
    groups = ["denom_records_group", "denom_patients_group"]
    shapes = {
        "table1_overall_flags": (["flag_type"], counts + totals_),
        "table2_campaign_flags": (["campaign", "flag_type"], counts + groups),
        "table3_product_flags": (["vax_product", "flag_type"], counts + totals_),
        "table4_interval_context": (["interval_context", "interval_bin"], counts + groups + totals_),
        "table5_campaign_transition": (["campaign_transition_type", "interval_bin"], counts + groups + totals_),
        "table6_product_transition": (["product_transition_type", "interval_bin"], counts + groups + totals_),
    }
    reported = {f"report_{name}": sql for name, sql in tables.items()}
    return tables | reported | {f"{name}_rounded": _rounded(tables[name], *shape) for name, shape in shapes.items()}


def _records() -> dict[str, str]:
    same_day = "flag_same_day_multiple, flag_same_day_same_product, flag_same_day_mixed_product"
    keys = "l_orderkey, l_linenumber"
    return {
        "campaign_windows": _windows(),
        "extract_events": _sql(
            f"""SELECT v.patient_id, v.vax_date, v.raw AS vax_product, {_age("born", "v.vax_date")} AS age, death_date
FROM vax v LEFT JOIN persons USING (patient_id) WHERE l_linestatus = '{standin.DISEASE}'""",
            PERSONS,
            VAX,
        ),
        "codelist_semi_join": """SELECT o_custkey AS patient_id, l_shipdate::DATE AS date, l_partkey AS code
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type IN ('PROMO', 'SMALL'))""",
        "population_filter": _sql(
            f"""SELECT DISTINCT patient_id FROM flu JOIN persons USING (patient_id)
WHERE {_age("born", _date(FLU.end))} >= {standin.MIN_AGE}""",
            PERSONS,
            FLU_RAW,
        ),
        "flu_extract": _sql(
            f"""SELECT patient_id, vax_date, {_age("born", "vax_date")} AS age FROM flu JOIN persons USING (patient_id)
WHERE source = 'drug' AND {_age("born", _date(FLU.end))} >= {standin.MIN_AGE}""",
            PERSONS,
            FLU_RAW,
        ),
        "registration_extract": _sql(
            f"""SELECT patient_id, first_day AS registration_start_date, last_day AS deregistration_date
FROM periods WHERE patient_id IN (SELECT patient_id FROM vax WHERE l_linestatus = '{standin.DISEASE}')""",
            PERIODS,
            VAX,
        ),
        "age_on_event": _sql(
            f"""SELECT patient_id, vax_date AS date, {_age("born", "vax_date")} AS age
FROM vax LEFT JOIN persons USING (patient_id)""",
            PERSONS,
            VAX,
        ),
        "campaign_assign": _sql(f"SELECT {keys}, patient_id, vax_date, campaign, campaign_rank FROM events_", *_EVENTS),
        "harmonise_product": _sql(
            f"SELECT {keys}, raw AS vax_product_raw, product AS vax_product, product_rank FROM events_", *_EVENTS
        ),
        "unmapped_products": _sql(
            """SELECT raw AS vax_product_raw, count(*) AS n_records FROM vax
WHERE raw NOT IN (SELECT raw FROM products WHERE product_rank <= 24) GROUP BY raw""",
            PRODUCTS,
            VAX,
        ),
        "date_flags": _sql(
            f"SELECT {keys}, patient_id, vax_date, flag_implausible_early_date, flag_pre_rollout_date FROM flagged",
            *_FLAGGED,
        ),
        "approval_flags": _sql(
            f"""SELECT {keys}, product AS vax_product, vax_date, approval_date,
  flag_unapproved_product, flag_product_before_approval FROM flagged""",
            *_FLAGGED,
        ),
        "same_day_pattern": _sql(
            f"""SELECT patient_id, vax_date, total_records_day, n_products_day, product_pattern,
  total_records_day > 1 AS flag_same_day_multiple,
  total_records_day > 1 AND n_products_day = 1 AS flag_same_day_same_product,
  total_records_day > 1 AND n_products_day > 1 AS flag_same_day_mixed_product
FROM (SELECT patient_id, vax_date, sum(n)::BIGINT AS total_records_day, count(*) AS n_products_day,
        string_agg(n || 'x ' || product, '  --AND-- ' ORDER BY product_rank) AS product_pattern
      FROM (SELECT patient_id, vax_date, product, product_rank, count(*) AS n FROM events_ GROUP BY ALL)
      GROUP BY patient_id, vax_date)""",
            *_EVENTS,
        ),
        "same_day_flags": _sql(
            f"""SELECT patient_id, vax_date, product AS vax_product, total_records_day, n_products_day, product_pattern, {same_day}
FROM flagged JOIN (
  SELECT patient_id, vax_date, string_agg(n || 'x ' || product, '  --AND-- ' ORDER BY product_rank) AS product_pattern
  FROM (SELECT patient_id, vax_date, product, product_rank, count(*) AS n FROM events_ GROUP BY ALL)
  GROUP BY patient_id, vax_date) USING (patient_id, vax_date)""",
            *_FLAGGED,
        ),
        "flags_long": _sql(
            "SELECT patient_id, vax_date, campaign, product AS vax_product, flag_type FROM long", *_LONG
        ),
        "dose_intervals": _sql(
            """SELECT patient_id, prev_date, vax_date, prev_product, product AS vax_product, prev_campaign, campaign,
  prev_campaign_stage, campaign_stage, interval_days, interval_bin, interval_context,
  campaign_transition_type, product_transition_type FROM gaps""",
            *_GAPS,
        ),
        "interval_bins": _sql(
            "SELECT patient_id, vax_date, interval_days, interval_bin, interval_bin_rank FROM gaps", *_GAPS
        ),
        "interval_context": _sql(
            "SELECT patient_id, vax_date, prev_campaign_stage, campaign_stage, interval_context FROM gaps", *_GAPS
        ),
        "active_on_date": _sql(
            "SELECT patient_id, vax_date, raw AS vax_product FROM active WHERE is_active", PERSONS, PERIODS, VAX, ACTIVE
        ),
        "active_flag_any": _sql(
            """SELECT patient_id, vax_date, raw AS vax_product, death_date, is_active AS active_on_vax_date
FROM active""",
            PERSONS,
            PERIODS,
            VAX,
            ACTIVE,
        ),
        "roundmid": _sql(
            f"""SELECT vax_date, source, n_records, {_midpoint("n_records", 10)} AS n_to_10,
  {_midpoint("(n_records - 1)", 6)} AS n_less_one_to_6, n_records AS n_to_0
FROM (SELECT vax_date, source, count(*) AS n_records FROM flu GROUP BY vax_date, source)""",
            FLU_RAW,
        ),
    }


def _sources() -> dict[str, str]:
    def dates(condition: str) -> str:
        return f"string_agg(DISTINCT vax_date::VARCHAR, ',' ORDER BY vax_date::VARCHAR) FILTER (WHERE {condition})"

    agreement = " UNION ALL ".join(
        f"""SELECT campaign, campaign IS NULL AS unknown, '{text}' AS comparison,
  {_midpoint(f"count(*) FILTER (WHERE {name})", 10)} AS n, {_midpoint(f"count({name})", 10)} AS denom
FROM agreed GROUP BY campaign"""
        for name, text in COMPARISONS
    )
    return {
        "flu_source_summary": _sql(
            f"""SELECT patient_id, campaign, source, count(*) AS n_vax,
  sum(n)::BIGINT AS n_vax_including_exact_duplicates,
  {dates("true")} AS vax_dates
FROM (SELECT patient_id, campaign, source, vax_date, {_age("born", "vax_date")} AS age, count(*) AS n
      FROM flu_c LEFT JOIN persons USING (patient_id) GROUP BY ALL)
GROUP BY patient_id, campaign, source""",
            PERSONS,
            *_FLU,
        ),
        "flu_union_sources": _sql("SELECT DISTINCT patient_id, campaign, source FROM flu_c", *_FLU),
        "flu_dates_wide": _sql(
            f"""SELECT patient_id, campaign, {dates("source = 'table'")} AS "table", {dates("source = 'drug'")} AS drug,
  {dates("source = 'snomed'")} AS snomed FROM flu_c GROUP BY patient_id, campaign""",
            *_FLU,
        ),
        "source_combination_person": _sql("SELECT * FROM combos", *_PRESENCE),
        "table_flu_sources": _sql(
            f"""SELECT campaign, source_combination, n AS n_source, tot_camp, perc_source,
  n || ' (' || {_number("perc_source")} || '%)' AS n_perc_source
FROM (SELECT *, {_tenth("share")} AS perc_source FROM (
  SELECT *, n::DOUBLE / tot_camp * 100 AS share FROM (
    SELECT *, sum(n) OVER (PARTITION BY campaign)::BIGINT AS tot_camp FROM upset)))""",
            *_PRESENCE,
            UPSET,
        ),
        "upset_counts": _sql('SELECT campaign, "table", drug, snomed, n FROM upset', *_PRESENCE, UPSET),
        "report_upset_counts": _sql('SELECT campaign, "table", drug, snomed, n FROM upset', *_PRESENCE, UPSET),
        "files_round_trip": _sql(
            """SELECT n.patient_id, n.campaign, n.source, c.n FROM (
  SELECT DISTINCT patient_id, campaign, source FROM flu_c) n
JOIN presence p ON p.patient_id = n.patient_id AND p.campaign IS NOT DISTINCT FROM n.campaign
JOIN upset c ON c.campaign IS NOT DISTINCT FROM p.campaign AND c."table" = p."table" AND c.drug = p.drug
  AND c.snomed = p.snomed
WHERE n.patient_id IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
            *_PRESENCE,
            UPSET,
        ),
        "upset_intersections": _sql(
            """SELECT campaign, source_combination AS combination, n,
  row_number() OVER (PARTITION BY campaign ORDER BY n DESC, source_combination)::INT AS rank FROM upset""",
            *_PRESENCE,
            UPSET,
        ),
        "upset_set_sizes": _sql(
            """SELECT campaign, source, sum(CASE WHEN present THEN n ELSE 0 END)::BIGINT AS n
FROM (SELECT campaign, 'table' AS source, "table" AS present, n FROM upset
      UNION ALL SELECT campaign, 'drug', drug, n FROM upset
      UNION ALL SELECT campaign, 'snomed', snomed, n FROM upset)
GROUP BY campaign, source""",
            *_PRESENCE,
            UPSET,
        ),
        "upset_uncount": _sql(
            """SELECT campaign, "table"::INT AS "table", drug::INT AS drug, snomed::INT AS snomed
FROM (SELECT *, unnest(range(n)) AS i FROM upset)""",
            *_PRESENCE,
            UPSET,
        ),
        "date_agreement_person": _sql(
            f"SELECT patient_id, campaign, {', '.join(name for name, _ in COMPARISONS)} FROM agreed",
            *_PRESENCE,
            AGREED,
        ),
        "date_agreement_bandjoin": _sql(
            "SELECT patient_id, campaign, within_7d_table_drug, within_7d_table_snomed FROM agreed",
            *_PRESENCE,
            AGREED,
        ),
        "table_date_agreement": _sql(
            f"""SELECT campaign, comparison, n, denom, pct,
  n || ' / ' || denom || ' (' ||
    CASE WHEN denom = 0 THEN 'NaN' ELSE {_number(_tenth("pct"))} END || '%)' AS n_pct
FROM (SELECT *, CASE WHEN denom = 0 THEN 'NaN'::DOUBLE ELSE 100 * n::DOUBLE / denom END AS pct
      FROM ({agreement}))""",
            *_PRESENCE,
            AGREED,
        ),
    }


def _kept() -> dict[str, str]:
    """Tables by deltas and by bitmaps must equal those counted at once; one campaign, those days."""
    tables = _tables()
    first, last = campaign_days(COVID, CLUSTERED_CAMPAIGN)
    return {
        "upkeep_campaign_flags": tables["table2_campaign_flags"],
        "upkeep_interval_context": tables["table4_interval_context"],
        "bitmap_overall_flags": tables["table1_overall_flags"],
        "bitmap_campaign_flags": tables["table2_campaign_flags"],
        "bitmap_product_flags": tables["table3_product_flags"],
        "clustered_extract": _sql(
            f"""SELECT patient_id, vax_date, raw AS vax_product FROM vax
WHERE vax_date BETWEEN {_date(first)} AND {_date(last)}""",
            VAX,
        ),
    }


def _source_sets() -> dict[str, str]:
    """Four sources: every set by testing each person, every pair by pairing up dates."""
    bits = ", ".join(f"({_text(name)}, {1 << bit})" for bit, name in enumerate(FOUR_SOURCES))
    names = ", ".join(f"CASE WHEN s & {1 << bit} > 0 THEN {_text(name)} END" for bit, name in enumerate(FOUR_SOURCES))
    records = f"""four AS (
  SELECT o_custkey AS patient_id, o_orderdate::DATE AS vax_date, 'table' AS source FROM orders
  UNION ALL
  SELECT o_custkey, l_shipdate::DATE, CASE l_returnflag WHEN 'A' THEN 'drug' WHEN 'N' THEN 'pharmacy' ELSE 'snomed' END
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag IN ('A', 'N', 'R'))"""
    labelled = f"four_c AS (SELECT four.*, campaign FROM four {_on_campaign('vax_date', 'fc')})"
    people = f"""people AS (
  SELECT patient_id, campaign, bit_or(bit) AS sources
  FROM four_c JOIN (VALUES {bits}) b(source, bit) USING (source) GROUP BY patient_id, campaign)"""
    exact = f"exact AS (SELECT campaign, sources, {_midpoint('count(*)', 10)} AS n FROM people GROUP BY campaign, sources)"
    sets = f"""SELECT campaign, CASE WHEN s = 0 THEN 'any' ELSE concat_ws(' + ', {names}) END AS source_set,
  bit_count(s)::INT AS n_sources, coalesce(sum(n) FILTER (WHERE sources = s), 0)::BIGINT AS n_exclusive,
  sum(n) FILTER (WHERE sources & s = s)::BIGINT AS n_inclusive, sum(n)::BIGINT AS n_people
FROM exact CROSS JOIN (SELECT unnest(range({1 << len(FOUR_SOURCES)}))::BIGINT AS s)
GROUP BY campaign, s HAVING count(*) FILTER (WHERE sources & s = s) > 0"""
    closest = """closest AS (
  SELECT a.patient_id, a.campaign, a.source AS first_source, b.source AS second_source,
    min(abs(a.vax_date - b.vax_date)) AS days
  FROM four_c a JOIN four_c b ON a.patient_id = b.patient_id AND a.campaign IS NOT DISTINCT FROM b.campaign
  GROUP BY ALL)"""
    pairs = ", ".join(
        f"({_text(a)}, {_text(b)})" for i, a in enumerate(FOUR_SOURCES) for b in FOUR_SOURCES[i + 1 :]
    )
    within = ", ".join(f"({days})" for days in AGREE_WITHIN)
    agreed = f"""SELECT c.campaign, p.first_source, p.second_source, w.within_days::INT AS within_days,
  {_midpoint("count(*) FILTER (WHERE x.days <= w.within_days)", 10)} AS n, {_midpoint("count(x.days)", 10)} AS denom
FROM (SELECT DISTINCT campaign FROM four_c) c CROSS JOIN (VALUES {pairs}) p(first_source, second_source)
CROSS JOIN (VALUES {within}) w(within_days)
LEFT JOIN closest x ON x.campaign IS NOT DISTINCT FROM c.campaign AND x.first_source = p.first_source
  AND x.second_source = p.second_source
GROUP BY c.campaign, p.first_source, p.second_source, w.within_days"""
    return {
        "source_set_intersections": _sql(sets, FC, records, labelled, people, exact),
        "source_pair_agreement": _sql(agreed, FC, records, labelled, closest),
    }


def _in_sql() -> dict[str, str]:
    """What the study's SQL functions must give, without them."""
    first, last = campaign_days(COVID, CLUSTERED_CAMPAIGN)
    age = _age("born", "vax_date")
    return {
        "arrow_extract": _sql(
            f"SELECT patient_id, vax_date FROM vax WHERE vax_date BETWEEN {_date(first)} AND {_date(last)}", VAX
        ),
        "sql_dose_intervals": _sql(
            "SELECT patient_id, prev_date, vax_date, interval_bin, interval_context FROM gaps", *_GAPS
        ),
        "sql_campaign_ages": _sql(
            f"""SELECT campaign_rank, campaign, from_day AS first_day, (to_day - 1)::DATE AS last_day,
  ({age}) // 10 AS decade, {_midpoint("count(*)", 10)} AS n
FROM vax JOIN persons USING (patient_id) {_on_campaign("vax_date")}
WHERE campaign LIKE 'Autumn%' OR campaign LIKE 'Spring%' GROUP BY ALL""",
            CC,
            PERSONS,
            VAX,
        ),
    }


ORACLE: dict[str, str] = (
    _records() | _tables() | _sources() | _injection() | _kept() | _source_sets() | _in_sql()
)
