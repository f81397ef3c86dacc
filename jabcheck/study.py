"""Study settings: dates, campaigns, product names and approvals.

A :class:`Study` is a plain description that every operator takes as a parameter.
:func:`covid_study` and :func:`flu_study` give the published settings.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta

UNMAPPED = "UNMAPPED"


@dataclass(frozen=True)
class Campaign:
    label: str
    start: date
    primary_milestone: date
    age_date: date
    early_milestone: date
    year: int | None = None
    age_threshold: int | None = None
    clinical_priority: str | None = None


@dataclass(frozen=True)
class Study:
    first_possible: date
    start: date
    end: date
    campaigns: tuple[Campaign, ...]
    #: day after the last campaign's final milestone
    calendar_close: date
    #: (label, raw name) in level order; tables sort by this order
    products: tuple[tuple[str, str], ...] = ()
    #: label -> approval date; labels left out are unapproved
    approvals: dict[str, date] = field(default_factory=dict)
    #: disclosure rounding precision
    threshold: int = 10
    #: first day of the range that early-date faults are drawn from
    early_faults_from: date = date(2019, 1, 1)

    @property
    def campaign_labels(self) -> list[str]:
        return [c.label for c in self.campaigns]

    @property
    def campaign_starts(self) -> list[date]:
        return [c.start for c in self.campaigns]

    @property
    def product_labels(self) -> list[str]:
        return [label for label, _ in self.products] + [UNMAPPED]

    @property
    def unmapped_rank(self) -> int:
        return len(self.products) + 1

    @property
    def approval_dates(self) -> list[date | None]:
        """Approval date by product rank, ``None`` where unapproved."""
        return [self.approvals.get(label) for label in self.product_labels]


# Statistical disclosure control precision.
SDC_THRESHOLD = 10

# COVID-19 campaigns as
# (label, start, primary milestone, age date, age threshold, clinical priority).
COVID_CAMPAIGNS = (
    ("Pre-2020-04-23", "1900-01-01", "1900-01-01", "1900-01-01", 16, "primis_atrisk"),
    ("Pre-roll-out", "2020-04-23", "2020-04-23", "2020-04-23", 16, "primis_atrisk"),
    ("Primary series", "2020-12-08", "2021-06-30", "2021-03-31", 16, "primis_atrisk"),
    ("Autumn 2021", "2021-09-06", "2022-02-28", "2021-08-31", 16, "primis_atrisk"),
    ("Spring 2022", "2022-03-21", "2022-06-30", "2022-06-30", 75, "immunosuppressed"),
    ("Autumn 2022", "2022-08-29", "2023-02-28", "2023-03-31", 50, "primis_atrisk"),
    ("Spring 2023", "2023-04-03", "2023-06-30", "2023-06-30", 75, "immunosuppressed"),
    ("Autumn 2023", "2023-08-28", "2024-02-28", "2024-03-31", 65, "primis_atrisk"),
    ("Spring 2024", "2024-04-15", "2024-06-30", "2024-06-30", 75, "immunosuppressed"),
    ("Autumn 2024", "2024-09-30", "2025-02-28", "2025-03-31", 65, "primis_atrisk"),
    ("Spring 2025", "2025-03-31", "2025-06-30", "2025-06-30", 75, "immunosuppressed"),
    ("Autumn 2025", "2025-09-29", "2026-02-28", "2026-03-31", 75, "primis_atrisk"),
)

# Product label and the raw name it stands for, in level order.
# Two raw names have two spaces before "(Pfizer Ltd)".
COVID_PRODUCTS = (
    ("pfizer_original", "COVID-19 mRNA Vaccine Comirnaty 30micrograms/0.3ml dose conc for susp for inj MDV (Pfizer)"),
    ("pfizer_BA1", "Comirnaty Original/Omicron BA.1 COVID-19 Vacc md vials"),
    ("pfizer_BA45", "Comirnaty Original/Omicron BA.4-5 COVID-19 Vacc md vials"),
    ("pfizer_XBB15", "Comirnaty Omicron XBB.1.5 COVID-19 Vacc md vials"),
    ("pfizer_JN1", "Comirnaty JN.1 COVID-19 mRNA Vaccine 0.3ml inj md vials (Pfizer Ltd)"),
    ("pfizer_LP81", "Comirnaty LP.8.1 COVID-19 Vacc 30microg/0.3ml dose inj pfs (Pfizer Ltd)"),
    ("pfizer_KP2", "Comirnaty KP.2 COVID-19 Vacc 30microg/0.3ml dose inj md vial (Pfizer Ltd)"),
    ("pfizer_KP2_pfs", "Comirnaty KP.2 COVID-19 Vacc 30microg/0.3ml dose inj pfs (Pfizer Ltd)"),
    ("pfizer_unspecified", "Comirnaty COVID-19 mRNA Vacc ready to use 0.3ml inj md vials"),
    (
        "pfizer_original_children",
        "COVID-19 mRNA Vaccine Comirnaty Children 5-11yrs 10mcg/0.2ml dose conc for disp for inj MDV (Pfizer)",
    ),
    ("pfizer_JN1_children", "Comirnaty JN.1 Children 5-11yrs COVID-19 Vacc 0.3ml sd vials (Pfizer Ltd)"),
    ("pfizer_XBB15_children", "Comirnaty Omicron XBB.1.5 Child 5-11y COVID-19 Vacc md vials"),
    ("pfizer_LP81_children", "Comirnaty LP.8.1 Children 5-11y COVID-19 Vacc 0.3ml sd vials  (Pfizer Ltd)"),
    ("pfizer_original_under5", "Comirnaty Children 6m-4yrs COVID-19 mRNA Vacc 0.2ml md vials"),
    ("pfizer_JN1_under5", "Comirnaty JN.1 Children 6m-4yrs COVID-19 Vacc 0.3ml md vials (Pfizer Ltd)"),
    ("pfizer_XBB15_under5", "Comirnaty Omicron XBB.1.5 Child 6m-4y COVID-19 Vacc md vials"),
    ("pfizer_LP81_under5", "Comirnaty LP.8.1 Children 6m-4y COVID-19 Vacc 0.3m md vials  (Pfizer Ltd)"),
    ("az_original", "COVID-19 Vaccine Vaxzevria 0.5ml inj multidose vials (AstraZeneca)"),
    (
        "az_original_half",
        "COVID-19 Vac AZD2816 (ChAdOx1 nCOV-19) 3.5x10*9 viral part/0.5ml dose sol for inj MDV (AstraZeneca)",
    ),
    (
        "moderna_original",
        "COVID-19 mRNA Vaccine Spikevax (nucleoside modified) 0.1mg/0.5mL dose disp for inj MDV (Moderna)",
    ),
    ("moderna_omicron", "COVID-19 Vac Spikevax (Zero)/(Omicron) inj md vials"),
    ("moderna_BA45", "COVID-19 Vacc Spikevax Orig/Omicron BA.4/BA.5 inj md vials"),
    ("moderna_XBB15", "COVID-19 Vacc Spikevax (XBB.1.5) 0.1mg/1ml inj md vials"),
    ("moderna_JN1", "Spikevax JN.1 COVID-19 Vacc 0.1mg/ml inj md vials (Moderna, Inc)"),
    ("moderna_omicron2", "COVID-19 Vaccine Moderna (mRNA-1273.529) 50micrograms/0.25ml dose sol for inj MDV"),
    ("moderna_unspecified", "COVID-19 Vaccine Moderna 0.5ml dispersion for inj vials"),
    ("sanofigsk_B1", "COVID-19 Vacc VidPrevtyn (B.1.351) 0.5ml inj multidose vials"),
    (
        "sanofigsk_D614",
        "COVID-19 Vac Sanofi (CoV2 preS dTM monovalent D614 (recombinant)) 5mcg/0.5ml dose susp for inj MDV",
    ),
    ("sanofigsk_D614B1", "COVID-19 Vacc Sanofi (D614+B.1.351) 0.5ml inj md vials"),
    ("novavax", "COVID-19 Vac Nuvaxovid (recombinant, adj) 5micrograms/0.5ml dose susp for inj MDV (Novavax CZ a.s.)"),
    ("sputnik_i_multi", "COVID-19 Vacc Sputnik V Component I 0.5ml multidose vials"),
    ("sputnik_ii_multi", "COVID-19 Vacc Sputnik V Component II 0.5ml multidose vials"),
    ("sputnik_i_inj", "COVID-19 Vaccine Sputnik V Component I 0.5ml inj vials"),
    ("sputnik_ii_inj", "COVID-19 Vaccine Sputnik V Component II 0.5ml inj vials"),
    (
        "jansenn",
        "COVID-19 Vaccine Janssen (Ad26.COV2-S (recomb)) 0.5ml dose solution for injection multidose vials",
    ),
    ("sinopharm", "COVID-19 Vac Sinopharm BIBP (inactivated adjuvanted) 6.5U/0.5ml dose susp for inj vials"),
    ("valneva", "COVID-19 Vaccine Valneva (inactivated adj whole virus) 40antigen units/0.5ml dose susp for inj MDV"),
    ("medicago", "COVID-19 Vaccine Medicago (CoVLP) 3.75micrograms/0.5ml dose emulsion for injection multidose vials"),
    ("convidecia", "COVID-19 Vaccine Convidecia 0.5ml inj vials"),
    ("covaxin", "COVID-19 Vac Covaxin (NIV-2020-770 inactivated) 6micrograms/0.5ml dose susp for inj MDV"),
    ("coronavac", "COVID-19 Vac CoronaVac (adjuvanted) 600U/0.5ml dose susp for inj vials"),
    (
        "covishield",
        "COVID-19 Vac Covishield (ChAdOx1 S recombinant) 5x10*9 viral particles/0.5ml dose sol for inj MDV",
    ),
    (
        "covovax",
        "COVID-19 Vac Covovax (adjuvanted) 5micrograms/0.5ml dose susp for inj MDV (Serum Institute of India)",
    ),
    ("unspecified", "SARS-2 Coronavirus vaccine"),
)

# Approval dates by product label.
COVID_APPROVALS = {
    "pfizer_original": "2020-12-02",
    "pfizer_BA1": "2022-09-03",
    "pfizer_BA45": "2022-09-11",
    "pfizer_XBB15": "2023-09-05",
    "pfizer_JN1": "2024-07-24",
    "az_original": "2020-12-30",
    "moderna_original": "2021-01-08",
    "moderna_omicron": "2022-08-15",
    "moderna_BA45": "2023-02-21",
    "moderna_XBB15": "2023-09-15",
    "moderna_JN1": "2024-09-02",
    "sanofigsk_B1": "2022-12-21",
}

# Target diseases as spelled in the vaccinations table.
COVID_DISEASE = "SARS-2 CORONAVIRUS"
FLU_DISEASE = "INFLUENZA"

# SNOMED CT codes for a recorded influenza vaccination.
FLU_SNOMED_CODES = (
    "1037311000000106",
    "1037331000000103",
    "1037351000000105",
    "1037371000000101",
    "1066171000000108",
    "1066181000000105",
    "1066191000000107",
    "1239861000000100",
    "884861000000100",
    "884881000000109",
    "945831000000105",
    "955651000000100",
    "955661000000102",
    "955671000000109",
    "955681000000106",
    "955691000000108",
    "955701000000108",
    "985151000000100",
    "985171000000109",
)

# dm+d codes of influenza vaccines.
FLU_DMD_CODES = (
    "27114211000001105",
    "34680411000001107",
    "35726811000001104",
    "40085011000001101",
    "40085311000001103",
    "42893311000001106",
    "43208811000001106",
)

#: an early milestone falls at the end of the eighth week of a COVID-19 campaign
EARLY_MILESTONE_DAYS = 7 * 8 - 1

#: youngest age at the end of the study for the influenza population
FLU_MIN_AGE = 12


def covid_study() -> Study:
    return Study(
        first_possible=date(2020, 4, 23),
        start=date(2020, 12, 8),
        end=date(2026, 12, 31),
        campaigns=tuple(
            Campaign(
                label=label,
                start=date.fromisoformat(start),
                primary_milestone=date.fromisoformat(primary),
                age_date=date.fromisoformat(age_date),
                early_milestone=date.fromisoformat(start) + timedelta(days=EARLY_MILESTONE_DAYS),
                age_threshold=threshold,
                clinical_priority=priority,
            )
            for label, start, primary, age_date, threshold, priority in COVID_CAMPAIGNS
        ),
        calendar_close=date(2030, 1, 1),
        products=COVID_PRODUCTS,
        approvals={label: date.fromisoformat(day) for label, day in COVID_APPROVALS.items()},
        threshold=SDC_THRESHOLD,
    )


def autumn_campaigns(first_year: int, last_year: int) -> tuple[Campaign, ...]:
    """A catch-all campaign from 1900, then one autumn campaign a year."""
    origin = date(1900, 1, 1)
    before = Campaign(f"Pre-{first_year}", origin, origin, origin, origin)
    return (
        before,
        *(
            Campaign(
                label=f"Autumn {year}",
                start=date(year, 9, 1),
                primary_milestone=date(year + 1, 3, 31),
                age_date=date(year + 1, 3, 31),
                early_milestone=date(year, 11, 30),
                year=year,
            )
            for year in range(first_year, last_year + 1)
        ),
    )


def flu_study() -> Study:
    return Study(
        first_possible=date(2005, 10, 1),
        start=date(2020, 10, 1),
        end=date(2026, 3, 31),
        campaigns=autumn_campaigns(2020, 2025),
        calendar_close=date(2026, 2, 1),
        threshold=SDC_THRESHOLD,
    )
