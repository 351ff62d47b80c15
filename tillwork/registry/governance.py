"""Queries over redaction, role views and data flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwork.functions import redaction
from tillwork.operators import governance as gov
from tillwork.registry.base import P_FCT, query
from tillwork.registry.payments import fct
from tillwork.schemas import STG_CUSTOMERS
from tillwork.operators.quality import enforce
from tillwork.sources import mapping


# The reference engine has no lookarounds, so a phone number is matched with the characters next to
# it, which are put back; a second pass finds numbers that share such a character with the first.
_PHONE = r"(^|[^\p{L}\p{N}_])((?:\+?1[ .-]?)?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4})($|[^\p{L}\p{N}_])"
_PHONE_SQL = rf"'{_PHONE}', '\1[REDACTED_PHONE]\3', 'g'"


def redaction_sql(table: str, keys: str) -> str:
    return rf"""
    with runs as (
      select *, list_distinct(regexp_extract_all(text, '\b(?:\d[ -]?){{12,18}}\d\b')) as found from {table}),
    cards as (
      select *, list_filter(found, lambda r: list_sum(list_transform(
          string_split(reverse(regexp_replace(r, '[^0-9]', '', 'g')), ''),
          lambda c, i: case when i % 2 = 1 then cast(c as integer)
                            when cast(c as integer) > 4 then cast(c as integer) * 2 - 9
                            else cast(c as integer) * 2 end)) % 10 = 0) as valid from runs),
    no_cards as (
      select *, list_reduce(list_prepend(text, valid), lambda t, r: replace(t, r, '[REDACTED_CARD]')) as t1 from cards),
    no_mail as (
      select *, regexp_replace(t1, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}', '[REDACTED_EMAIL]', 'g') as t2
      from no_cards),
    no_phone as (
      select {keys}, regexp_replace(regexp_replace(t2, {_PHONE_SQL}), {_PHONE_SQL}) as text from no_mail),
    redacted as (
      select *, cast(len(regexp_extract_all(text, '\[REDACTED_(CARD|EMAIL|PHONE)\]')) as integer) as redactions from no_phone)"""


# The whole rule for texts of any script: digits are decimal digits, a number stands between characters
# other than letters, numbers and underscores, and every run is judged at its own place. Without lookarounds,
# such characters are doubled first, so that two numbers beside one of them have one each. A card-like run is
# set between marks (1, 3); a 1 of the text itself becomes (1, 2) until they are split.
_OUT = r"[^\p{L}\p{N}_]"
_SEP = r"(?:  |\.\.|--)?"
_CARD_TWO = rf"({_OUT})((?:\p{{Nd}}(?:  |--)?){{12,18}}\p{{Nd}})({_OUT})"
_PHONE_TWO = (rf"({_OUT})(?:(?:\+\+)?1{_SEP})?(?:\(\()?\p{{Nd}}{{3}}(?:\)\))?{_SEP}\p{{Nd}}{{3}}{_SEP}\p{{Nd}}{{4}}({_OUT})")
_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def _twice(text: str) -> str:
    return rf"regexp_replace(concat(' ', {text}, ' '), '({_OUT})', '\1\1', 'g')"


def _once(text: str) -> str:
    return rf"regexp_replace({text}, '({_OUT}){_OUT}', '\1', 'g')"


REDACT_TEXT_SQL = rf"""
    with texts as (select doc_id, text as t0 from documents where text is not null),
    marked as (
      select doc_id, string_split(regexp_replace({_twice("replace(t0, chr(1), chr(1) || chr(2))")}, '{_CARD_TWO}',
                                                 concat('\1', chr(1), chr(3), '\2', chr(1), chr(3), '\3'), 'g'),
                                  chr(1) || chr(3)) as parts from texts),
    judged as (
      select doc_id, list_transform(parts, lambda p, i: case when i % 2 = 0 and list_sum(list_transform(
          string_split(reverse(regexp_replace(translate(p, '{redaction.DIGITS}', '{redaction.PLAIN}'), '[^0-9]', '', 'g')), ''),
          lambda c, k: case when k % 2 = 1 then cast(c as integer)
                            when cast(c as integer) > 4 then cast(c as integer) * 2 - 9
                            else cast(c as integer) * 2 end)) % 10 = 0 then null else {_once("p")} end) as parts from marked),
    no_cards as (
      select doc_id, len(list_filter(parts, lambda p: p is null)) as n1,
             array_to_string(list_transform(parts, lambda p: coalesce(p, '[REDACTED_CARD]')), '') as padded from judged),
    plain as (
      select doc_id, n1, replace(substring(padded, 2, length(padded) - 2), chr(1) || chr(2), chr(1)) as t1 from no_cards),
    no_mail as (
      select doc_id, n1 + len(regexp_extract_all(t1, '{_EMAIL}')) as n2,
             regexp_replace(t1, '{_EMAIL}', '[REDACTED_EMAIL]', 'g') as t2 from plain),
    wide as (select doc_id, n2, {_twice("t2")} as t2 from no_mail),
    no_phone as (
      select doc_id, n2 + len(regexp_extract_all(t2, '{_PHONE_TWO}')) as n3,
             {_once(rf"regexp_replace(t2, '{_PHONE_TWO}', '\1[[REDACTED_PHONE]]\2', 'g')")} as t3 from wide)
    select doc_id, substring(t3, 2, length(t3) - 2) as text, cast(n3 as integer) as redactions from no_phone
    union all select doc_id, null, null from documents where text is null"""


@query("redact_text", REDACT_TEXT_SQL)
def _(spark, sf_dir):
    return redaction.redact(mapping.table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


@query("redact_conversations", redaction_sql("conversations", "conv_id, turn, role") + " select * from redacted")
def _(spark, sf_dir):
    return redaction.redact_conversations(mapping.table(spark, sf_dir, "conversations"))


@query("conversation_redactions", redaction_sql("conversations", "conv_id, turn, role") + """
    select conv_id, count(*) as messages, cast(sum(redactions) as bigint) as redactions from redacted group by 1""")
def _(spark, sf_dir):
    return redaction.conversation_totals(redaction.redact_conversations(mapping.table(spark, sf_dir, "conversations")))


def scan_sql(column: str) -> str:
    return rf"""
    select '{column}' as column_name, kind, count(*) filter (where n > 0) as row_count, cast(sum(n) as bigint) as hits from (
      select unnest(['card', 'email', 'phone']) as kind, unnest([
        len(list_filter(regexp_extract_all({column}, '\b(?:\d[ -]?){{12,18}}\d\b'), lambda r: list_sum(list_transform(
          string_split(reverse(regexp_replace(r, '[^0-9]', '', 'g')), ''),
          lambda c, i: case when i % 2 = 1 then cast(c as integer)
                            when cast(c as integer) > 4 then cast(c as integer) * 2 - 9
                            else cast(c as integer) * 2 end)) % 10 = 0)),
        len(regexp_extract_all({column}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}')),
        len(regexp_extract_all(regexp_replace(regexp_replace({column}, {_PHONE_SQL}), {_PHONE_SQL}),
                               '\[REDACTED_PHONE\]'))]) as n
      from documents) group by 1, 2"""


@query("pii_scan", " union all ".join(scan_sql(c) for c in ("text", "lang", "source")))
def _(spark, sf_dir):
    return redaction.pii_scan(mapping.table(spark, sf_dir, "documents"))


@query("pii_email_scan", r"""
    select count(*) filter (where n > 0) as row_count, cast(sum(n) as bigint) as hits
    from (select len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) as n from documents)""")
def _(spark, sf_dir):
    found = redaction.pii_scan(mapping.table(spark, sf_dir, "documents"), ["text"])
    return found.where("kind = 'email'").select("row_count", "hits")


@query("role_view_analyst", f"with {P_FCT} select * exclude (customer_email_hash) from p_fct")
def _(spark, sf_dir):
    return gov.role_view(fct(spark, sf_dir), gov.ROLES["analyst"], "marts")


@query("role_view_fraud_ops", """
    select cast(c_custkey as varchar) as customer_id, c_name as full_name, concat(' ', c_name, '@Example.com ') as email,
           concat('403-555-', lpad(cast(c_custkey % 10000 as varchar), 4, '0')) as phone,
           concat('C', cast(c_nationkey as varchar)) as country,
           timestamp '2020-01-01' as created_at, timestamp '2020-01-01' as updated_at from customer""")
def _(spark, sf_dir):
    people = enforce(mapping.customers(spark, sf_dir), STG_CUSTOMERS)
    return gov.role_view(people, gov.ROLES["fraud_ops"], "staging")


# A flow graph from the order tables: customers feed their orders, orders feed their lines.

G_EDGES = """
edges as (
  select concat('c', cast(o_custkey as varchar)) as src, concat('o', cast(o_orderkey as varchar)) as dst,
         o_orderpriority = '1-URGENT' as masked from orders
  union all
  select concat('o', cast(l_orderkey as varchar)),
         concat('l', cast(l_orderkey as varchar), '-', cast(l_linenumber as varchar)), l_returnflag = 'R' from lineitem),
pii as (select concat('c', cast(c_custkey as varchar)) as column_name from customer where c_mktsegment = 'BUILDING'),
published as (select distinct concat('l', cast(l_orderkey as varchar), '-', cast(l_linenumber as varchar)) as column_name
              from lineitem where l_linestatus = 'F' and l_quantity >= 49),
reached as (
  with recursive walk as (
    select column_name as pii_column, column_name, false as masked from pii
    union
    select w.pii_column, e.dst, w.masked or e.masked from walk w join edges e on w.column_name = e.src
    where e.dst not in (select column_name from pii))
  select * from walk),
flows as (
  select pii_column, column_name, bool_and(masked) as masked from reached
  where column_name in (select column_name from published) group by 1, 2)"""


def flow_graph(spark, sf_dir):
    orders, lines = mapping.table(spark, sf_dir, "orders"), mapping.table(spark, sf_dir, "lineitem")

    def named(prefix, *keys):
        return F.concat(F.lit(prefix), F.concat_ws("-", *[F.col(k).cast("string") for k in keys]))

    line = named("l", "l_orderkey", "l_linenumber")
    edges = orders.select(named("c", "o_custkey").alias("src"), named("o", "o_orderkey").alias("dst"),
                          (F.col("o_orderpriority") == "1-URGENT").alias("masked")).unionAll(
        lines.select(named("o", "l_orderkey").alias("src"), line.alias("dst"), (F.col("l_returnflag") == "R").alias("masked")))
    pii = mapping.table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(
        named("c", "c_custkey").alias("column_name"))
    published = lines.where("l_linestatus = 'F' and l_quantity >= 49").select(line.alias("column_name")).distinct()
    return edges, pii, published


@query("pii_flows", f"with {G_EDGES} select * from flows")
def _(spark, sf_dir):
    return gov.pii_flows(*flow_graph(spark, sf_dir))


@query("pii_contained", f"""with {G_EDGES}
    select column_name from pii where column_name not in (select pii_column from flows)""")
def _(spark, sf_dir):
    edges, pii, published = flow_graph(spark, sf_dir)
    return gov.contained(pii, gov.pii_flows(edges, pii, published))


@query("model_neighbors", """
    select distinct 'reads from' as relation, concat('s', cast(l_suppkey as varchar)) as name from lineitem where l_partkey = 7
    union all
    select distinct case when l_returnflag = 'R' then 'tested by' else 'read by' end,
           concat('o', cast(l_orderkey as varchar)) from lineitem where l_partkey = 7""")
def _(spark, sf_dir):
    """Suppliers feed parts and parts feed orders; returned ones play the tests."""
    lines = mapping.table(spark, sf_dir, "lineitem")
    part = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    edges = lines.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), part.alias("dst"),
                         F.lit("model").alias("dst_type")).unionAll(
        lines.select(part.alias("src"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("dst"),
                     F.when(F.col("l_returnflag") == "R", "test").otherwise("model").alias("dst_type")))
    return gov.neighbors(edges, "p7")
