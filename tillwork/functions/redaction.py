"""Redaction of card numbers, email addresses and phone numbers in text, as JVM expressions."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and placeholders (fixed values). Digits are decimal digits of any script; a card or phone number
# stands between characters other than letters, numbers and underscores. The email pattern may only start
# where a run of address characters starts, or where the last match ended: the same matches, without
# rescanning a long run from each of its characters.
# The letter U+10000 in the class, spelt out, makes the JVM look back by whole characters, not by half ones.
_WORD = "[\\p{L}\\p{N}_\U00010000]"
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
CARD = rf"(?<!{_WORD})(?:\p{{Nd}}[ -]?){{12,18}}\p{{Nd}}(?!{_WORD})"
PHONE = rf"(?<!{_WORD})(?:\+?1[ .-]?)?\(?\p{{Nd}}{{3}}\)?[ .-]?\p{{Nd}}{{3}}[ .-]?\p{{Nd}}{{4}}(?!{_WORD})"
CARD_MARK, EMAIL_MARK, PHONE_MARK = "[REDACTED_CARD]", "[REDACTED_EMAIL]", "[REDACTED_PHONE]"

# Decimal digits of all scripts, and their plain forms.
DIGITS = "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd")
PLAIN = "".join(str(unicodedata.digit(c)) for c in DIGITS)


def luhn_valid(digits: Column) -> Column:
    """Whether a text of digits passes the Luhn checksum."""
    length = F.length(digits)

    def add(total, i):
        d = F.substring(digits, i + 1, F.lit(1)).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == length % 2, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), length - 1), F.lit(0), add) % 10 == 0


def card_runs(text: Column) -> Column:
    """Digit runs that look like card numbers, with separators."""
    return F.regexp_extract_all(text, F.lit(CARD), F.lit(0))


def is_card(run: Column) -> Column:
    digits = F.regexp_replace(F.translate(run, DIGITS, PLAIN), "[^0-9]", "")
    return luhn_valid(digits)


def redact(df: DataFrame, column: str, count: str = "redactions") -> DataFrame:
    """Replace valid card numbers, then emails, then phone numbers in the whole text, and count
    the replacements. A longer digit run that fails the checksum is left as it is."""
    helpers = ("_runs", "_gaps", "_valid", "_text", "_mail")
    runs = df.withColumns({"_runs": card_runs(F.col(column)), "_gaps": F.split(F.col(column), CARD, -1)})
    checked = runs.withColumn("_valid", F.transform("_runs", is_card))
    # Text without a card-like run, which is nearly all of it, is passed on untouched.
    marked = F.zip_with("_runs", "_valid", lambda run, ok: F.when(ok, F.lit(CARD_MARK)).otherwise(run))
    rebuilt = F.array_join(F.zip_with("_gaps", marked, lambda gap, run: F.concat(gap, F.coalesce(run, F.lit("")))), "")
    cards = checked.withColumn("_text", F.when(F.size("_runs") > 0, rebuilt).otherwise(F.col(column)))
    mails = cards.withColumn("_mail", F.regexp_replace("_text", EMAIL, _literal(EMAIL_MARK)))
    total = (F.size(F.filter("_valid", lambda ok: ok)) + F.regexp_count("_text", F.lit(EMAIL))
             + F.regexp_count("_mail", F.lit(PHONE)))
    return (mails.withColumns({column: F.regexp_replace("_mail", PHONE, _literal(PHONE_MARK)), count: total})
            .drop(*helpers))


def _literal(replacement: str) -> str:
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


def flatten_parts(messages: DataFrame, column: str) -> DataFrame:
    """One row per text part of multi-part messages, `column` being array<struct<type, text>>."""
    return (messages.select("*", F.posexplode(column).alias("part", "_p")).where("_p.type = 'text'")
            .withColumn(column, F.col("_p.text")).drop("_p"))


def redact_conversations(messages: DataFrame, column: str = "text") -> DataFrame:
    return redact(messages, column)


def conversation_totals(redacted: DataFrame, key: str = "conv_id") -> DataFrame:
    """Replacements per conversation."""
    return redacted.groupBy(key).agg(F.count(F.lit(1)).alias("messages"), F.sum("redactions").alias("redactions"))


def pii_scan(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Personal data found in the values of the text columns: (column_name, kind, row_count, hits).
    One pass over the table."""
    names = columns or [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    hits = {}
    for name in names:
        text = F.col(name)
        hits[name, "card"] = F.size(F.filter(card_runs(text), is_card))
        hits[name, "email"] = F.regexp_count(text, F.lit(EMAIL))
        hits[name, "phone"] = F.regexp_count(text, F.lit(PHONE))
    counted = df.select(*[h.alias(f"h{i}") for i, h in enumerate(hits.values())])
    totals = counted.agg(*[agg for i in range(len(hits)) for agg in (
        F.count_if(F.col(f"h{i}") > 0).alias(f"r{i}"), F.coalesce(F.sum(f"h{i}"), F.lit(0)).alias(f"s{i}"))])
    rows = [F.struct(F.lit(n).alias("column_name"), F.lit(k).alias("kind"), F.col(f"r{i}").alias("row_count"),
                     F.col(f"s{i}").alias("hits")) for i, (n, k) in enumerate(hits)]
    return totals.select(F.explode(F.array(*rows)).alias("f")).select("f.*")
