"""Queries of transfer netting and money flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillweave.operators import flows as W
from tillweave.operators import netting as N
from tillweave.plans.ledger_views import MIN_SHARE, MIN_SHARE_SUB, led, sql
from tillweave.plans.registry import query

# Greedy matching as a recursive walk over the candidates of each amount, with a list of what is taken.
_CAND = """legs as (select ord, date, account, abs(amount) k, amount > 0 credit from led where is_transfer and date is not null and amount <> 0 and account is not null),
cand as (select a.k, abs(date_diff('day', a.date, b.date))::int delta, least(a.ord, b.ord) i, greatest(a.ord, b.ord) j from legs a join legs b
  on a.k = b.k and not a.credit and b.credit and a.account <> b.account and abs(date_diff('day', a.date, b.date)) <= 3)"""
_WALK = """num as (select *, row_number() over (partition by k order by delta, i, j) n from cand),
walk(k, n, taken, i, j, delta, ok) as (
  select k, n, [i, j], i, j, delta, true from num where n = 1
  union all
  select c.k, c.n, case when list_contains(w.taken, c.i) or list_contains(w.taken, c.j) then w.taken else list_concat(w.taken, [c.i, c.j]) end, c.i, c.j, c.delta,
    not (list_contains(w.taken, c.i) or list_contains(w.taken, c.j)) from walk w join num c on c.k = w.k and c.n = w.n + 1),
pairs as (select delta, i, j, row_number() over (order by delta, i, j) - 1 pair_id from walk where ok),
ends as (select i as ord, pair_id from pairs union all select j, pair_id from pairs),
net as (select l.*, e.pair_id from led l left join ends e on e.ord = l.ord)"""


def net_sql(body: str, *ctes: str) -> str:
    return sql(body, _CAND, _WALK, *ctes).replace("with led", "with recursive led", 1)


def netted(spark, sf_dir):
    return N.net_transfers(led(spark, sf_dir))


@query("transfer_candidates", sql("select delta, i, j from cand", _CAND))
def transfer_candidates(spark, sf_dir):
    return N.candidates(led(spark, sf_dir)).select("delta", "i", "j")


@query("transfer_pairs", net_sql("select delta, i, j from pairs"))
def transfer_pairs(spark, sf_dir):
    return N.transfer_pairs(led(spark, sf_dir))


@query("transfer_pairs_next_day", net_sql("select delta, i, j from pairs").replace("a.date, b.date)) <= 3", "a.date, b.date)) <= 1"))
def transfer_pairs_next_day(spark, sf_dir):
    return N.transfer_pairs(led(spark, sf_dir), 1)


@query("netted_ledger", net_sql("select ord, account, amount, is_transfer, pair_id from net"))
def netted_ledger(spark, sf_dir):
    return netted(spark, sf_dir).select("ord", "account", "amount", "is_transfer", "pair_id")


@query("unmatched_transfers", net_sql("select ord, date, description, amount, account from net where is_transfer and pair_id is null"))
def unmatched_transfers(spark, sf_dir):
    return N.unmatched(netted(spark, sf_dir)).select("ord", "date", "description", "amount", "account")


_SPEND, _INCOME = "not is_transfer and amount < 0", "not is_transfer and amount > 0"
_IN = f"""ip as (select coalesce(nullif(subcategory, ''), nullif(category, ''), '(uncategorised)') label, account, sum(amount) v, count(*) c from led where {_INCOME} group by 1, 2),
il as (select label, case when sum(v) < {MIN_SHARE} * (select sum(v) from ip) then 'Other income' else label end shown from ip group by label),
fi as (select 'income' source_layer, shown source, 'account' target_layer, account target, sum(v)::decimal(38,2) "value", sum(c)::bigint "count" from ip join il using (label) group by shown, account)"""
_OUT = f"""sp as (select account, case when category = '' then '(uncategorised)' else category end label, subcategory, sum(-amount) v, count(*) c from led where {_SPEND} group by 1, 2, 3),
sl as (select label, case when label <> '(uncategorised)' and sum(v) < {MIN_SHARE} * (select sum(v) from sp) then 'Other' else label end shown from sp group by label),
fc as (select 'account' source_layer, account source, 'category' target_layer, shown target, sum(v)::decimal(38,2) "value", sum(c)::bigint "count" from sp join sl using (label) group by account, shown),
fs as (select 'category' source_layer, shown source, 'subcategory' target_layer, shown || '/' || subcategory target, sum(v)::decimal(38,2) "value", sum(c)::bigint "count" from sp join sl using (label)
  where subcategory <> '' and shown not in ('Other', '(uncategorised)') group by shown, subcategory having sum(v) >= {MIN_SHARE_SUB} * (select sum(v) from sp))"""
_XFER = """pr as (select pair_id, arg_min(account, amount) payer, arg_max(account, amount) payee, max(amount) amount from net where pair_id is not null group by pair_id having count(*) = 2),
pa as (select least(payer, payee) low, greatest(payer, payee) high, coalesce(sum(amount) filter (payer <= payee), 0) forth, coalesce(sum(amount) filter (payer > payee), 0) back, count(*) * 2 c, min(pair_id) p from pr group by 1, 2),
ft as (select case when forth > back then low else high end source, case when forth > back then high else low end target, abs(forth - back)::decimal(38,2) "value", c::bigint "count", greatest(forth, back)::decimal(38,2) gross_with, least(forth, back)::decimal(38,2) gross_against, p from pa where forth <> back),
fu as (select 'account' source_layer, account source, 'category' target_layer, 'Transfers (unmatched)' target, sum(-amount)::decimal(38,2) "value", count(*) "count" from net where is_transfer and pair_id is null and amount < 0 group by account
  union all select 'category', 'Transfers (unmatched)', 'account', account, sum(amount)::decimal(38,2), count(*) from net where is_transfer and pair_id is null and amount > 0 group by account)"""
_LINK = 'source_layer, source, target_layer, target, "value", "count"'
_ALL = f"""fa as (select 'account' source_layer, source, 'account' target_layer, target, "value", "count" from ft union all select {_LINK} from fu union all select {_LINK} from fi union all select {_LINK} from fc union all select {_LINK} from fs)"""
_NODES = """nt as (select layer, label, sum(v)::decimal(38,2) total from (select source_layer layer, source label, "value" v from fa union all select target_layer, target, "value" from fa) group by layer, label)"""


_SEEN = f"""inc as (select ord, account, shown from (select *, coalesce(nullif(subcategory, ''), nullif(category, ''), '(uncategorised)') label from led where {_INCOME}) join il using (label)),
spe as (select ord, account, shown, subcategory from (select *, case when category = '' then '(uncategorised)' else category end label from led where {_SPEND}) join sl using (label)),
lone as (select ord, account from net where is_transfer and pair_id is null and amount <> 0),
seen as (select 'account' layer, source label, 1 ph, p f, 0 pos from ft union all select 'account', target, 1, p, 1 from ft union all select 'account', account, 2, ord, 0 from lone union all select 'category', 'Transfers (unmatched)', 2, ord, 1 from lone
  union all select 'income', shown, 3, ord, 0 from inc union all select 'account', account, 3, ord, 1 from inc union all select 'account', account, 4, ord, 0 from spe union all select 'category', shown, 4, ord, 1 from spe
  union all select 'category', shown, 5, ord, 0 from spe join fs on fs.target = shown || '/' || subcategory union all select 'subcategory', shown || '/' || subcategory, 5, ord, 1 from spe join fs on fs.target = shown || '/' || subcategory),
met as (select layer, label, min(ph::hugeint * 1000000000000000 + f * 2 + pos) at_ from seen group by layer, label)"""


@query("flow_income", sql(f"select {_LINK} from fi", _IN))
def flow_income(spark, sf_dir):
    return W.income_flows(led(spark, sf_dir), MIN_SHARE).select(*W.LINK)


@query("flow_account_category", sql(f"select {_LINK} from fc", _OUT))
def flow_account_category(spark, sf_dir):
    return W.account_category_flows(led(spark, sf_dir), MIN_SHARE).select(*W.LINK)


@query("flow_category_sub", sql(f"select {_LINK} from fs", _OUT))
def flow_category_sub(spark, sf_dir):
    return W.category_sub_flows(led(spark, sf_dir), MIN_SHARE, MIN_SHARE_SUB).select(*W.LINK)


@query("flow_transfers_net", net_sql('select source, target, "value", "count", gross_with, gross_against from ft', _XFER))
def flow_transfers_net(spark, sf_dir):
    return W.transfer_flows(netted(spark, sf_dir)).drop("phase", "first")


@query("flow_unmatched", net_sql(f"select {_LINK} from fu", _XFER))
def flow_unmatched(spark, sf_dir):
    return W.unmatched_flows(netted(spark, sf_dir)).select(*W.LINK)


def _links(spark, sf_dir):
    return W.all_links(netted(spark, sf_dir), MIN_SHARE, MIN_SHARE_SUB)


@query("flow_links", net_sql(f"select {_LINK} from fa", _XFER, _IN, _OUT, _ALL))
def flow_links(spark, sf_dir):
    return _links(spark, sf_dir).select(*W.LINK)


@query("flow_links_gross", net_sql(f"select {_LINK}, gross_with, gross_against from fa left join (select source, target, gross_with, gross_against, 'account' tl from ft) g using (source, target) where source_layer = 'account' and target_layer = 'account'", _XFER, _IN, _OUT, _ALL))
def flow_links_gross(spark, sf_dir):
    """Net transfers with what flowed with and against them, as the figure tells on hover."""
    return _links(spark, sf_dir).filter("phase = 1").select(*W.LINK, *W.GROSS)


@query("flow_nodes", net_sql("select layer, label, total from nt", _XFER, _IN, _OUT, _ALL, _NODES))
def flow_nodes(spark, sf_dir):
    return W.node_totals(_links(spark, sf_dir)).drop("met")


@query("flow_node_rank", net_sql("select layer, label, total, row_number() over w as rank, round(least(greatest((row_number() over w - 0.5) / count(*) over (partition by layer), 0.001), 0.999), 6)::double as y from nt join met using (layer, label) window w as (partition by layer order by total desc, at_)", _XFER, _IN, _OUT, _ALL, _NODES, _SEEN))
def flow_node_rank(spark, sf_dir):
    return W.node_places(_links(spark, sf_dir)).withColumn("y", F.col("y").cast("double"))


@query("flow_conservation", net_sql(f"""select (select sum("value") from fa where source_layer = 'account' and target_layer <> 'account')::decimal(38,2) as outflow,
  ((select coalesce(sum(-amount), 0) from led where {_SPEND}) + (select coalesce(sum(-amount), 0) from net where is_transfer and pair_id is null and amount < 0))::decimal(38,2) as spent""", _XFER, _IN, _OUT, _ALL))
def flow_conservation(spark, sf_dir):
    net = netted(spark, sf_dir)
    out = W.all_links(net, MIN_SHARE, MIN_SHARE_SUB).filter("source_layer = 'account' and target_layer <> 'account'").agg(F.sum("value").cast("decimal(38,2)").alias("outflow"))
    debit = (~F.col("is_transfer") & (F.col("amount") < 0)) | (F.col("is_transfer") & F.col("pair_id").isNull() & (F.col("amount") < 0))
    return out.join(F.broadcast(net.agg(F.sum(F.when(debit, -F.col("amount"))).cast("decimal(38,2)").alias("spent"))))
