"""Settings, metric specs and line items, as plain values; small dimension tables are made from them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

FACTORS = ["quality", "growth", "valuation", "health"]
OFFICIAL_WEIGHTS = dict.fromkeys(FACTORS, 25.0)
SEGMENTS = ["operating", "pre_revenue", "banks", "insurers", "capital_markets", "reits"]
#: The measure of return that gates growth, by segment.
RETURN_METRIC = {
    "operating": "roic", "pre_revenue": "roic", "banks": "roe", "insurers": "roe", "capital_markets": "roe", "reits": "ffo_assets",
}


@dataclass(frozen=True)
class Settings:
    """Thresholds of a scoring run."""

    cap_floor: float = 1e9
    adv_floor: float = 5e6
    retention: float = 0.8
    min_filings: int = 5
    report_age: int = 200
    carry_age: int = 300
    coverage: float = 0.70
    min_cohort: int = 12
    applicability: float = 0.40
    winsor: tuple[float, float] = (5.0, 95.0)
    hurdle: float = 0.09
    tax_clamp: tuple[float, float] = (0.0, 0.35)
    default_tax: float = 0.21
    sweep: tuple[int, ...] = (10, 15, 20, 25, 30, 35, 40)
    drift_warn: float = 1.0
    drift_block: float = 5.0
    drift_horizon: int = 450
    price_review: float = 0.50
    #: Where rows of thin groups are ranked: "pool", among each other, or "segment", among all.
    thin_fallback: str = "pool"
    #: Rows of a cohort up to which a window, in one task, ranks it.
    window_rows: int = 2_000_000


@dataclass(frozen=True)
class Metric:
    """One measure: its factor, direction, the segments it is for, and how it counts."""

    key: str
    factor: str
    higher_better: bool = True
    segments: tuple[str, ...] = ()
    optional: bool = False
    conditioned: bool = False


def _metrics() -> list[Metric]:
    o, op, b, i, k, r = ("operating",), ("operating", "pre_revenue"), ("banks",), ("insurers",), ("capital_markets",), ("reits",)
    q, g, v, h = FACTORS
    return [
        Metric("roic", q, segments=op), Metric("gpoa", q, segments=op), Metric("earn_var", q, False), Metric("delta_gpoa", q, segments=op),
        Metric("ebit_ev", v, segments=op), Metric("ebitda_ev", v, segments=op), Metric("fcf_ev", v, segments=op),
        Metric("rev_growth", g, conditioned=True), Metric("op_inc_change", g, segments=o, optional=True),
        Metric("debt_equity", h, False, segments=op + i + k + r), Metric("net_debt_ebitda", h, False, segments=op), Metric("altman_z", h, segments=op),
        Metric("roe", q, segments=b + i + k), Metric("roa", q, segments=b + i + k), Metric("earn_yield", v, segments=b + i + k),
        Metric("book_yield", v, segments=i + k + r), Metric("equity_assets", h, segments=b + i + k), Metric("profit_growth", g, segments=b + i + k, conditioned=True),
        Metric("ffo_assets", q, segments=r), Metric("ffo_yield", v, segments=r), Metric("debt_assets", h, False, segments=r),
        Metric("net_debt_ffo", h, False, segments=r), Metric("ffo_growth", g, segments=r, conditioned=True),
        Metric("efficiency", q, False, segments=b, optional=True), Metric("nii_growth", g, segments=b, optional=True, conditioned=True),
        Metric("ptbv_gap", v, segments=b, optional=True), Metric("credit_cost", h, False, segments=b, optional=True),
        Metric("loss_ratio", q, False, segments=i, optional=True), Metric("cost_ratio", q, False, segments=i, optional=True),
        Metric("invest_yield", q, segments=i, optional=True), Metric("premium_growth", g, segments=i, optional=True, conditioned=True),
        Metric("reserves_equity", h, False, segments=i, optional=True), Metric("op_margin", q, segments=k, optional=True),
        Metric("net_margin", q, segments=k, optional=True), Metric("comp_ratio", q, False, segments=k, optional=True),
    ]


METRICS = _metrics()

#: Items and the concepts that report them, in order of preference.
LINE_ITEMS = {
    "revenue": [
        "RevenueFromContractWithCustomerExcludingAssessedTax",
        "Revenues",
        "RevenueFromContractWithCustomerIncludingAssessedTax",
        "SalesRevenueNet",
        "SalesRevenueGoodsNet",
        "RevenuesNetOfInterestExpense",
    ],
    "cost": [
        "CostOfGoodsAndServicesSold",
        "CostOfRevenue",
        "CostOfGoodsSold",
        "CostOfServices",
        "CostOfGoodsAndServicesSoldExcludingDepreciationDepletionAndAmortization",
        "CostOfRevenueExcludingDepreciationDepletionAndAmortization",
        "CostOfGoodsSoldExcludingDepreciationDepletionAndAmortization",
        "CostOfGoodsAndServiceExcludingDepreciationDepletionAndAmortization",
    ],
    "gross_profit": ["GrossProfit"],
    "operating_income": ["OperatingIncomeLoss"],
    "operating_expense": ["OperatingExpenses", "OperatingCostsAndExpenses"],
    "costs_and_expenses": ["CostsAndExpenses"],
    "pretax": [
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest",
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments",
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesDomestic",
    ],
    "interest": ["InterestExpense", "InterestExpenseNonoperating", "InterestExpenseDebt", "InterestAndDebtExpense"],
    "tax": ["IncomeTaxExpenseBenefit", "IncomeTaxExpenseBenefitContinuingOperations"],
    "net_income": ["NetIncomeLoss", "ProfitLoss", "NetIncomeLossAvailableToCommonStockholdersBasic"],
    "da": ["DepreciationDepletionAndAmortization", "DepreciationAmortizationAndAccretionNet", "DepreciationAndAmortization", "Depreciation"],
    "ocf": ["NetCashProvidedByUsedInOperatingActivities", "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"],
    "capex": [
        "PaymentsToAcquirePropertyPlantAndEquipment",
        "PaymentsToAcquireProductiveAssets",
        "PaymentsForCapitalImprovements",
        "PaymentsToAcquireOtherPropertyPlantAndEquipment",
        "PaymentsToAcquireOtherProductiveAssets",
    ],
    "assets": ["Assets"],
    "current_assets": ["AssetsCurrent"],
    "liabilities": ["Liabilities"],
    "balance_total": ["LiabilitiesAndStockholdersEquity"],
    "current_liabilities": ["LiabilitiesCurrent"],
    "equity": ["StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"],
    "retained": ["RetainedEarningsAccumulatedDeficit"],
    "cash": ["CashAndCashEquivalentsAtCarryingValue", "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents", "CashAndDueFromBanks"],
    "debt_combined": ["DebtLongtermAndShorttermCombinedAmount"],
    "debt_noncurrent": [
        "LongTermDebtNoncurrent",
        "LongTermDebtAndCapitalLeaseObligations",
        "UnsecuredLongTermDebt",
        "ConvertibleDebtNoncurrent",
        "SecuredLongTermDebt",
        "LongTermNotesPayable",
        "ConvertibleLongTermNotesPayable",
        "SeniorLongTermNotes",
    ],
    "debt_lt_current": [
        "LongTermDebtCurrent",
        "LongTermDebtAndCapitalLeaseObligationsCurrent",
        "ConvertibleDebtCurrent",
        "SeniorNotesCurrent",
        "NotesPayableCurrent",
        "UnsecuredDebtCurrent",
        "SecuredDebtCurrent",
        "LoansPayableCurrent",
        "ConvertibleNotesPayableCurrent",
    ],
    "debt_short": ["ShortTermBorrowings", "OtherShortTermBorrowings", "CommercialPaper"],
    "debt_lt_total": [
        "LongTermDebt",
        "LongTermDebtAndCapitalLeaseObligationsIncludingCurrentMaturities",
        "SeniorNotes",
        "UnsecuredDebt",
        "SecuredDebt",
        "ConvertibleDebt",
        "NotesPayable",
        "LoansPayable",
        "DebtAndCapitalLeaseObligations",
        "ConvertibleNotesPayable",
    ],
    "nii": ["InterestIncomeExpenseNet"],
    "noninterest_income": ["NoninterestIncome"],
    "noninterest_expense": ["NoninterestExpense"],
    "provision": ["ProvisionForLoanLeaseAndOtherLosses", "ProvisionForLoanLossesExpensed", "ProvisionForCreditLosses"],
    "goodwill": ["Goodwill"],
    "intangibles": ["IntangibleAssetsNetExcludingGoodwill", "FiniteLivedIntangibleAssetsNet"],
    "preferred": ["PreferredStockValue"],
    "premiums": ["PremiumsEarnedNet"],
    "claims": ["PolicyholderBenefitsAndClaimsIncurredNet"],
    "benefits": ["BenefitsLossesAndExpenses"],
    "reserves": ["LiabilityForClaimsAndClaimsAdjustmentExpense"],
    "investment_income": ["NetInvestmentIncome"],
    "compensation": ["LaborAndRelatedExpense", "SalariesWagesAndOfficersCompensation"],
    "eps": ["EarningsPerShareDiluted", "EarningsPerShareBasicAndDiluted", "EarningsPerShareBasic"],
    "one_off_gain": [
        "GainLossOnSaleOfBusiness",
        "GainLossOnDispositionOfBusiness",
        "GainLossOnDispositionOfAssets",
        "GainLossOnDispositionOfAssets1",
        "GainLossOnSaleOfOtherAssets",
        "GainLossOnSaleOfPropertyPlantEquipment",
        "GainLossRelatedToLitigationSettlement",
        "DeconsolidationGainOrLossAmount",
        "BusinessCombinationBargainPurchaseGainRecognizedAmount",
    ],
    "one_off_charge": [
        "GoodwillImpairmentLoss",
        "AssetImpairmentCharges",
        "TangibleAssetImpairmentCharges",
        "ImpairmentOfIntangibleAssetsExcludingGoodwill",
        "ImpairmentOfIntangibleAssetsFinitelived",
        "ImpairmentOfIntangibleAssetsIndefinitelivedExcludingGoodwill",
        "ImpairmentOfLongLivedAssetsHeldAndUsed",
        "RestructuringCharges",
        "RestructuringSettlementAndImpairmentProvisions",
        "RestructuringCostsAndAssetImpairmentCharges",
    ],
    "bought": ["PaymentsForRepurchaseOfCommonStock", "PaymentsForRepurchaseOfEquity"],
    "issued": ["ProceedsFromIssuanceOfCommonStock", "ProceedsFromIssuanceOrSaleOfEquity"],
    "fund_holdings": ["InvestmentOwnedAtFairValue"],
}
#: Fixed value: items whose concepts nest. Of a flow, the largest in the newest filing counts, not the first.
LARGEST_WINS = {"revenue"}
#: Items whose concepts are looked at one by one.
BY_CONCEPT = {"one_off_gain", "one_off_charge"}
#: Concepts that may hold one class of debt instead of all of it.
DEBT_PARTS = [
    "UnsecuredLongTermDebt", "ConvertibleDebtNoncurrent", "SecuredLongTermDebt", "LongTermNotesPayable",
    "SeniorNotes", "UnsecuredDebt", "SecuredDebt", "ConvertibleDebt", "NotesPayable", "LoansPayable",
    "ConvertibleLongTermNotesPayable", "SeniorLongTermNotes", "ConvertibleNotesPayable",
]
#: Concepts that hold a slice of debt and are read by no item; who has one did borrow.
DEBT_SLICES = [
    "NotesAndLoansPayable", "SubordinatedDebt", "JuniorSubordinatedNotes", "OtherLongTermDebt",
    "OtherLongTermDebtNoncurrent", "LineOfCredit", "OtherBorrowings",
    "CommercialPaperAtCarryingValue", "LoansPayableToBankCurrent",
]
DEBT_ITEMS = ["debt_combined", "debt_noncurrent", "debt_lt_current", "debt_short", "debt_lt_total"]
#: Names of concepts that speak of borrowing, and those among them that do not.
DEBT_LIKE = "(Debt|Borrowing|NotesPayable|LoansPayable|LineOfCredit|CommercialPaper|Subordinated|SeniorNotes)"
DEBT_NOISE = (
    "(LiabilitiesOtherThan|TradingSecurities|"
    "AvailableForSale|DebtSecurities|HeldToMaturity|Lease|StockIssued|Interest|"
    "Proceeds|Repayment|Payments|Extinguishment|Conversion|Issuance|Adjustments|"
    "Capacity|Unused|Commitment|Remaining|Maximum|Percentage|Ratio|Average|Disclosure|"
    "Covenant|FairValue|Maturit|Unamortized|Discount|Premium|Weighted|Number|Face|Pledged)"
)
#: Families of concepts that may have replaced one that no longer resolves, and the noise among them.
CANDIDATE_FAMILIES = {
    "debt": "(Debt|Notes|Borrowing|LoansPayable|CommercialPaper|LineOfCredit|Subordinated)",
    "operating_income": "(OperatingIncome|InterestExpense)",
    "cost_of_revenue": "^Costs?Of",
    "capex": "^PaymentsToAcquire",
    "operating_cash_flow": "^NetCashProvidedByUsedInOperating",
}
CANDIDATE_NOISE = (
    "(Receivable|Proceeds|Repayment|FairValue|Maturit|Unamortized|Discount|Premium|Securities|"
    "Investment|Extinguishment|Covenant|Rate|Weighted|Number|Face|Principal|Increase|Decrease|"
    "Gain|Loss|Allowance|Capacity|Guarantee|Instrument|Business|Intangible|Marketable|"
    "Share|Compensation|InterestExpenseOperating|Deposits|"
    "Payments|Average|Disclosure|Adjustments|Conversion|Issuance|Unused|Commitment|Remaining|Maximum)"
)


@dataclass
class Registry:
    """Metric specs as a table; tests and stand-in data bring their own."""

    metrics: list[Metric] = field(default_factory=lambda: list(METRICS))

    def table(self, spark: SparkSession) -> DataFrame:
        """(metric, factor, higher_better, segments, optional, conditioned); as long as the registry."""
        rows = [(m.key, m.factor, m.higher_better, list(m.segments), m.optional, m.conditioned) for m in self.metrics]
        return spark.createDataFrame(rows, "metric string, factor string, higher_better boolean, segments array<string>, optional boolean, conditioned boolean")


def line_items(spark: SparkSession) -> DataFrame:
    """(item, concept, priority, largest_wins)."""
    rows = [(item, c, k, item in LARGEST_WINS) for item, concepts in LINE_ITEMS.items() for k, c in enumerate(concepts)]
    return spark.createDataFrame(rows, "item string, concept string, priority int, largest_wins boolean")


def weight_tuples(sweep: tuple[int, ...] = Settings.sweep) -> list[tuple[float, ...]]:
    """Every combination of factor weights from the sweep that sums to 100."""
    from itertools import product

    return [tuple(map(float, w)) for w in product(sweep, repeat=len(FACTORS)) if sum(w) == 100]


def weight_vectors(spark: SparkSession, sweep: tuple[int, ...] = Settings.sweep) -> DataFrame:
    """``weight_tuples`` as a table."""
    rows = [(k, *w) for k, w in enumerate(weight_tuples(sweep))]
    return spark.createDataFrame(rows, "vector int, " + ", ".join(f"w_{f} double" for f in FACTORS))
