"""Money flows as nodes and links: income to accounts, accounts to categories, categories to subcategories,
net transfers between accounts and unmatched legs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillweave.functions.columns import TOTAL, UNCATEGORISED, income_label, total
from tillweave.session import written

OTHER, OTHER_INCOME, UNMATCHED = "Other", "Other income", "Transfers (unmatched)"
MIN_SHARE, MIN_SHARE_SUB = "0.01", "0.005"
LINK = ("source_layer", "source", "target_layer", "target", "value", "count")
#: When a link is first met: phases in this order, within one by the first row (of transfers: the first pair).
TRANSFER, LEFT_OVER, INCOME, SPENT, PARTS = range(1, 6)
MET = ("phase", "first")
GROSS = ("gross_with", "gross_against")
_RATE = "decimal(10,6)"


def _with_grand(totals: DataFrame) -> DataFrame:
    """totals with the sum over all of them, a one-row aggregate."""
    return totals.join(F.broadcast(totals.agg(F.coalesce(F.sum("amount"), F.lit(0)).cast(TOTAL).alias("grand"))))


def _below(share: str):
    """Strictly below a share of the grand total, multiplied out so that nothing is rounded."""
    return F.col("amount").cast("decimal(28,2)") < F.col("grand").cast("decimal(24,2)") * F.lit(share).cast(_RATE)


def _link(df: DataFrame, phase: int, source_layer: str, source, target_layer: str, target, value="value") -> DataFrame:
    keyed = df.groupBy(source.alias("source"), target.alias("target")).agg(total(value).alias("value"), F.sum("count").alias("count"), F.min("first").alias("first"))
    return keyed.select(F.lit(source_layer).alias("source_layer"), "source", F.lit(target_layer).alias("target_layer"), "target", "value", F.col("count").cast("long").alias("count"), F.lit(phase).alias("phase"), "first")


_CUBE = ("account", "category", "subcategory", "is_transfer", "paired", "side")


def cube(rows: DataFrame) -> DataFrame:
    """All that flows need of the rows, summed: one pass with map-side partials, then as small as the labels.

    side is -1, 0 or 1 by the sign of the amount, value its absolute sum. A cube is its own cube.
    """
    if "side" in rows.columns:
        return rows
    paired = F.col("pair_id").isNotNull() if "pair_id" in rows.columns else F.lit(False)
    place = F.col("ord") if "ord" in rows.columns else F.lit(None).cast("long")
    keyed = rows.select("account", "category", "subcategory", "is_transfer", paired.alias("paired"), F.signum("amount").cast("int").alias("side"), "amount", place.alias("_ord"))
    return keyed.groupBy(*_CUBE).agg(total(F.abs("amount")).alias("value"), F.count("*").alias("count"), F.min("_ord").alias("first"))


def income_flows(rows: DataFrame, min_share: str = MIN_SHARE) -> DataFrame:
    """Income labels to accounts; labels below min_share of all income flow together."""
    earned = cube(rows).filter(~F.col("is_transfer") & (F.col("side") > 0))
    per = earned.groupBy(income_label(F.col("category"), F.col("subcategory")).alias("label"), "account").agg(total("value").alias("value"), F.sum("count").alias("count"), F.min("first").alias("first"))
    small = _with_grand(per.groupBy("label").agg(F.sum("value").alias("amount"))).select("label", F.when(_below(min_share), OTHER_INCOME).otherwise(F.col("label")).alias("shown"))
    return _link(per.join(small, "label"), INCOME, "income", F.col("shown"), "account", F.col("account"))


def spend_labels(rows: DataFrame, min_share: str = MIN_SHARE) -> DataFrame:
    """(category, shown): categories below min_share of all spend are shown as one; the uncategorised never."""
    sums = _with_grand(_spend(rows).groupBy("label").agg(total("value").alias("amount")))
    return sums.select("label", F.when(_below(min_share) & (F.col("label") != UNCATEGORISED), OTHER).otherwise(F.col("label")).alias("shown"))


def _spend(rows: DataFrame) -> DataFrame:
    label = F.when(F.col("category") == "", UNCATEGORISED).otherwise(F.col("category"))
    spent = cube(rows).filter(~F.col("is_transfer") & (F.col("side") < 0))
    return spent.groupBy("account", label.alias("label"), "subcategory").agg(total("value").alias("value"), F.sum("count").alias("count"), F.min("first").alias("first"))


def account_category_flows(rows: DataFrame, min_share: str = MIN_SHARE) -> DataFrame:
    return _link(_spend(rows).join(spend_labels(rows, min_share), "label"), SPENT, "account", F.col("account"), "category", F.col("shown"))


def category_sub_flows(rows: DataFrame, min_share: str = MIN_SHARE, min_share_sub: str = MIN_SHARE_SUB) -> DataFrame:
    """Shown categories to their subcategories, except those small by their share of all spend.

    Blank subcategories, the uncategorised and whatever is shown as Other have no leaves. A leaf is named by
    its path, as two categories may share a name of a subcategory.
    """
    spend = _spend(rows).join(spend_labels(rows, min_share), "label")
    grand = spend.agg(F.coalesce(F.sum("value"), F.lit(0)).cast(TOTAL).alias("grand"))
    leaves = spend.filter((F.col("subcategory") != "") & ~F.col("shown").isin(OTHER, UNCATEGORISED))
    per = leaves.groupBy("shown", "subcategory").agg(F.sum("value").cast(TOTAL).alias("amount"), F.sum("count").alias("count"), F.min("first").alias("first")).join(F.broadcast(grand))
    kept = per.filter(~_below(min_share_sub)).withColumn("leaf", F.concat_ws("/", "shown", "subcategory"))
    return _link(kept, PARTS, "category", F.col("shown"), "subcategory", F.col("leaf"), "amount")


def transfer_flows(netted: DataFrame) -> DataFrame:
    """Net flow of matched transfers for each pair of accounts, from the one that paid more; with gross sums.

    Pairs of ids that don't have two rows are left out; flows that cancel out have no link.
    """
    pairs = netted.filter(F.col("pair_id").isNotNull()).groupBy("pair_id").agg(F.min_by("account", "amount").alias("payer"), F.max_by("account", "amount").alias("payee"), F.max("amount").alias("amount"), F.count("*").alias("n"))
    low, high = F.least("payer", "payee"), F.greatest("payer", "payee")
    sums = pairs.filter("n = 2").groupBy(low.alias("low"), high.alias("high")).agg(
        total(F.when(F.col("payer") == low, F.col("amount"))).alias("forth"), total(F.when(F.col("payer") != low, F.col("amount"))).alias("back"), (F.count("*") * 2).alias("count"), F.min("pair_id").alias("first")
    )
    ahead = F.col("forth") > F.col("back")
    return sums.filter("forth <> back").select(
        F.when(ahead, F.col("low")).otherwise(F.col("high")).alias("source"),
        F.when(ahead, F.col("high")).otherwise(F.col("low")).alias("target"),
        F.abs(F.col("forth") - F.col("back")).cast(TOTAL).alias("value"),
        "count",
        F.greatest("forth", "back").alias("gross_with"),
        F.least("forth", "back").alias("gross_against"),
        F.lit(TRANSFER).alias("phase"),
        "first",
    )


def unmatched_flows(netted: DataFrame) -> DataFrame:
    """Unmatched legs by account and direction, towards one node of fixed name."""
    legs = cube(netted).filter(F.col("is_transfer") & ~F.col("paired") & (F.col("side") != 0)).select("account", (F.col("side") < 0).alias("debit"), "value", "count", "first")
    out = _link(legs.filter("debit"), LEFT_OVER, "account", F.col("account"), "category", F.lit(UNMATCHED))
    return out.unionByName(_link(legs.filter(~F.col("debit")), LEFT_OVER, "category", F.lit(UNMATCHED), "account", F.col("account")))


def all_links(netted: DataFrame, min_share: str = MIN_SHARE, min_share_sub: str = MIN_SHARE_SUB) -> DataFrame:
    """All links, with when each is first met, and of net transfers what flowed with and against them."""
    sums = written(cube(netted), "flows")
    transfers = transfer_flows(netted).select(F.lit("account").alias("source_layer"), "source", F.lit("account").alias("target_layer"), "target", "value", "count", *MET, *GROSS)
    parts = (transfers, unmatched_flows(sums), income_flows(sums, min_share), account_category_flows(sums, min_share), category_sub_flows(sums, min_share, min_share_sub))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def node_totals(links: DataFrame) -> DataFrame:
    """Each node with what flows in and out of it, summed, and when it is first met.

    A link meets its source first, but for legs left over, which meet the account first.
    """
    backwards = ((F.col("phase") == LEFT_OVER) & (F.col("source_layer") == "category")).cast("int")
    end = lambda layer, label, place: F.struct(F.col(layer).alias("layer"), F.col(label).alias("label"), place.alias("place"))
    ends = links.select(F.explode(F.array(end("source_layer", "source", backwards), end("target_layer", "target", 1 - backwards))).alias("_n"), "value", *MET)
    return ends.groupBy(F.col("_n.layer").alias("layer"), F.col("_n.label").alias("label")).agg(total("value").alias("total"), F.min(F.struct(*MET, F.col("_n.place").alias("place"))).alias("met"))


def node_places(links: DataFrame) -> DataFrame:
    """Nodes ranked by size in their layer, those first met first among equals, with the height at which they are drawn."""
    in_layer = Window.partitionBy("layer")
    ranked = node_totals(links).withColumn("rank", F.row_number().over(in_layer.orderBy(F.desc("total"), "met", "label")).cast("long")).withColumn("_n", F.count("*").over(in_layer))
    y = F.least(F.greatest((F.col("rank") - 0.5) / F.col("_n"), F.lit(0.001)), F.lit(0.999))
    return ranked.withColumn("y", F.round(y, 6)).drop("_n", "met")
