"""Classification of listings: what is common stock, which segment and peer group it belongs to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortal.functions.scalars import safe_div

#: Words of a name that rule a listing out as an operating company's common stock, and those that rule it in.
NOT_COMMON = (
    r"(?i)\b(warrant|right|unit|preferred|depositary|debenture|note|bond|trust|fund|etf|etn|"
    r"acquisition corp|acquisitions corp|spac|closed end|closed-end|index|portfolio)\b"
)
COMMON = r"(?i)(common stock|ordinary share|common share|class [a-z] )"
#: Sectors and industry labels that segments and peer groups are told by.
FINANCIAL_SECTORS = ["Finance", "Real Estate"]
FINANCIAL_INDUSTRY = (
    "(?i)(bank|insur|invest|financ|broker|savings institution|real estate|"
    "trusts except|building operators)"
)
REIT_INDUSTRY = "(?i)(real estate|building operators|trusts except)"
INSURER_INDUSTRY = "(?i)insur"
BROKER_INDUSTRY = "(?i)(broker|investment banker)"
BANK_INDUSTRY = "(?i)(bank|savings institution|consumer services|finance companies)"
LENDER_INDUSTRY = "(?i)(consumer services|finance companies)"
LIFE_INDUSTRY = "(?i)(life|accident|health)"
BIOTECH_INDUSTRY = "(?i)(biotechnolog|pharmaceutical preparation|medicinal chemical)"
PRE_REVENUE_BELOW = 10_000_000
LENDER_MARGIN = 0.04
LARGE_BANK, MID_BANK = 20e9, 3e9


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def is_common_stock(name: Column | str) -> Column:
    """No word of the first list, then one of the second; a null name is none."""
    return ~_text(name).rlike(NOT_COMMON) & _text(name).rlike(COMMON)


def segment(sector: Column, industry: Column, revenue: Column, nii: Column, assets: Column, is_fund: Column, evidence: bool = True) -> Column:
    """One of the six segments, by sector and industry; both must speak of finance.

    A label of lenders makes a bank only if it is a fund or earns interest on its assets; with ``evidence=False``, before
    there are figures, the label alone does. A biotechnology label without revenue is pre-revenue.
    """
    industry = _text(industry)
    financial = _text(sector).isin(FINANCIAL_SECTORS) & industry.rlike(FINANCIAL_INDUSTRY)
    lends = F.coalesce(is_fund, F.lit(False)) | F.coalesce(safe_div(nii, assets) >= LENDER_MARGIN, F.lit(False))
    bank = F.when(industry.rlike(LENDER_INDUSTRY) & ~lends, "operating").otherwise("banks") if evidence else F.lit("banks")
    return (
        F.when(financial & industry.rlike(REIT_INDUSTRY), "reits")
        .when(financial & industry.rlike(INSURER_INDUSTRY), "insurers")
        .when(financial & industry.rlike(BROKER_INDUSTRY), "capital_markets")
        .when(financial & industry.rlike(BANK_INDUSTRY), bank)
        .when(financial, "capital_markets")
        .when(industry.rlike(BIOTECH_INDUSTRY) & (revenue.isNull() | (revenue < PRE_REVENUE_BELOW)), "pre_revenue")
        .otherwise("operating")
    )


def peer_group(segment: Column, sector: Column, industry: Column, cap: Column) -> Column:
    """The group inside which a listing is compared: its sector or, in the financial segments, its closest kind; null without a sector."""
    industry, cap = _text(industry), F.coalesce(cap, F.lit(0.0))
    bank = F.when(cap >= LARGE_BANK, "Large banks").when(cap >= MID_BANK, "Regional banks").otherwise("Community banks")
    bank = F.when(industry.rlike(LENDER_INDUSTRY), "Consumer & specialty lenders").otherwise(bank)
    insurer = F.when(industry.rlike(LIFE_INDUSTRY), "Life & health insurers").otherwise("Property & casualty insurers")
    market = F.when(industry.rlike(BROKER_INDUSTRY), "Brokers & capital markets").otherwise("Asset managers & other")
    grouped = F.when(segment == "banks", bank).when(segment == "insurers", insurer).when(segment == "capital_markets", market).otherwise(sector)
    return F.when(_text(sector) != "", grouped)


def build_label(month: Column, run_day: Column, backtested: Column, rebuilt: list[str], lag: int = 7) -> Column:
    """``backtested``, ``rebuilt`` (named months, or a run more than ``lag`` days late) or ``live``."""
    late = F.datediff(run_day, F.last_day(F.to_date(F.concat(month, F.lit("-01"))))) > lag
    return F.when(backtested, "backtested").when(month.isin(rebuilt) | late, "rebuilt").otherwise("live")
