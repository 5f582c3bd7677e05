"""Distress rules, labels and their agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.ratios import Z_DISTRESS, altman, previous_year

METHODS = ("RULE_BASED", "Z_SCORE", "HYBRID")

# Rule codes and their names.
RULES = {
    "R1": "Lỗ 2 năm liên tiếp",
    "R2": "Vốn chủ sở hữu âm",
    "R3": "Lợi nhuận chưa phân phối âm",
    "R4": "EBIT không đủ trả chi phí lãi vay",
    "R5": "Dòng tiền kinh doanh (OCF) âm kéo dài",
    "R6": "Nợ ngắn hạn vượt quá tài sản ngắn hạn",
}


def rule_flags() -> dict[str, Column]:
    """Whether each rule fires; a missing value never fires a rule."""
    interest = F.col("interest_expense")
    tests = {
        "R1": (F.col("net_profit") < 0) & (previous_year("net_profit") < 0),
        "R2": F.col("equity") < 0,
        "R3": F.col("retained_earnings") < 0,
        "R4": (interest > 0) & (F.col("ebit") < interest),
        "R5": (F.col("operating_cash_flow") < 0) & (previous_year("operating_cash_flow") < 0),
        "R6": F.col("current_liabilities") > F.col("current_assets"),
    }
    return {code: F.coalesce(test, F.lit(False)) for code, test in tests.items()}


def with_rules(statements: DataFrame) -> DataFrame:
    """Add one flag per rule and the number of rules that fired."""
    flagged = statements.withColumns(rule_flags())
    fired = sum((F.col(code).cast("int") for code in RULES), F.lit(0))
    return flagged.withColumn("rules_fired", fired)


def rule_checks() -> Column:
    """The flags as a list of rule records."""
    return F.array(
        *[
            F.struct(F.lit(code).alias("rule_code"), F.lit(name).alias("rule_name"), F.col(code).alias("triggered"))
            for code, name in RULES.items()
        ]
    )


def label(method: str = "HYBRID", z_threshold: float = Z_DISTRESS, min_rules: int = 2) -> Column:
    """1 for distress: enough rules, a low Z-score, or either of them."""
    by_rules = F.col("rules_fired") >= min_rules
    by_score = F.coalesce(F.col("z_score") < z_threshold, F.lit(False))
    chosen = {"RULE_BASED": by_rules, "Z_SCORE": by_score, "HYBRID": by_rules | by_score}
    if method not in chosen:
        raise ValueError(f"unknown labelling method {method!r}")
    return chosen[method].cast("int")


def status() -> Column:
    warned = (F.col("zone") == "GREY") | (F.col("rules_fired") == 1)
    return F.when(F.col("distress_label") == 1, "DISTRESS").when(warned, "WARNING").otherwise("SAFE")


def distress_labels(
    statements: DataFrame, method: str = "HYBRID", z_threshold: float = Z_DISTRESS
) -> DataFrame:
    """Rules, Z-score, label and status per company and year."""
    judged = altman(with_rules(statements))
    return judged.withColumn("distress_label", label(method, z_threshold)).withColumn(
        "distress_status", status()
    )


def label_agreement(statements: DataFrame) -> DataFrame:
    """How often the rule label and the score label agree."""
    judged = altman(with_rules(statements))
    return (
        judged.select(label("RULE_BASED").alias("rule_label"), label("Z_SCORE").alias("z_label"))
        .groupBy("rule_label", "z_label")
        .agg(F.count("*").alias("rows"))
    )
