"""The decision model: choices by the words of their descriptions, yes-or-no questions by words; ranking, request, rules.

The default model needs no service: an option scores the distinct words (four letters or more) of its id and
description that the state holds.  Another model can take its place: anything that gives the answer columns.
A taxonomy is a list of (id, description); the ones here are examples in our own words.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import rounded

Taxonomy = Sequence[tuple[str, str]]
DEPARTMENTS: Taxonomy = (
    ("finance", "invoices, receipts, budgets, forecasts, bank statements, taxes and audits"), ("legal", "contracts with outside parties, claims, disputes, compliance, trademarks"), ("hr", "hiring, salaries, reviews, training, leave and everything about staff"), ("sales", "leads, quotes, customer orders, discounts, price lists, pipeline"),
    ("marketing", "campaigns, brand, website copy, newsletters, press releases"), ("product-engineering", "specifications, designs, source code, tests, releases"), ("operations", "purchasing, warehouse, shipping, delivery, yard, procedures, safety"), ("it-security", "accounts, devices, passwords, backups, migration, incidents, servers"),
    ("customer-support", "tickets, complaints, returns, refunds, warranty"), ("management", "strategy, board meetings, goals, announcements, project decisions"), ("other", "nothing of these"),
)
SENSITIVITY: Taxonomy = (("public", "published: press release, website, newsletter, price list"), ("internal", "everyday work: minutes, procedures, plans, stock"), ("confidential", "contract, discount, supplier, invoice, forecast, customer list"), ("restricted", "personal data, salary, passport, password, private key, bank account"))
TAGS: Taxonomy = (("draft", "draft, unfinished, todo"), ("final", "final, signed, approved"), ("action-required", "reply, return, please, friday, deadline"), ("pricing", "discount, price, rates, margin"))
LEVELS = ("public", "internal", "confidential", "restricted")
RESTRICTED_COLUMNS = ("national_id", "bank_card", "salary", "health", "credentials")


def words_of(text: Column | str) -> Column:
    """The distinct words of four or more letters a to z, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), F.lit("[a-z]{4,}"), F.lit(0)))


def option_words(option: str, description: str) -> list[str]:
    return list(dict.fromkeys(re.findall("[a-z]{4,}", f"{option} {description}".lower())))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def scores(words: Column, taxonomy: Taxonomy) -> Column:
    """(id, ord, score) of each option; half a point less for the options that say none."""

    def of(w: Column) -> Column:
        return F.array(*(F.struct(F.lit(o).alias("id"), F.lit(k).alias("ord"), (F.size(F.array_intersect(w, F.array(*map(F.lit, option_words(o, d))))) - (0.5 if o in ("other", "none") else 0.0)).alias("score")) for k, (o, d) in enumerate(taxonomy)))

    return let(words, of)


def ranked(scored: Column) -> Column:
    """Options by score, most first; at a tie as they are listed."""
    return F.array_sort(F.transform(scored, lambda x: F.struct((-x["score"]).alias("minus"), x["ord"].alias("ord"), x["id"].alias("id"), x["score"].alias("score"))))


def answer(words: Column, taxonomy: Taxonomy) -> Column:
    """Struct: choice, confidence, runner_up and the probability of each option."""
    share = lambda x: F.greatest(x["score"], F.lit(0.0)) + 1

    def of(r: Column) -> Column:
        best = F.get(r, F.lit(0))
        return let(
            F.aggregate(r, F.lit(0.0), lambda a, x: a + share(x)),
            lambda total: F.struct(
                best["id"].alias("choice"), rounded(F.least(F.lit(0.99), 0.5 + best["score"] / 10)).alias("confidence"), F.get(r, F.lit(1))["id"].alias("runner_up"),
                F.transform(r, lambda x: F.struct(x["id"].alias("id"), rounded(share(x) / total).alias("p"))).alias("probabilities"),
            ),
        )

    return let(ranked(scores(words, taxonomy)), of)


def tag_scores(words: Column, tags: Taxonomy = TAGS, at_least: float = 0.7) -> Column:
    """The tags of which the state holds words: 0.4 for the first and 0.2 for each further one, from a bound on."""
    own = lambda w: F.array(*(F.when(F.least(F.lit(1.0), 0.3 + 0.2 * F.size(F.array_intersect(w, F.array(*map(F.lit, option_words(t, d)))))) >= at_least, F.lit(t)) for t, d in tags))
    return F.filter(let(words, own), lambda x: x.isNotNull())


def request(fields: dict[str, Column]) -> Column:
    """The request as JSON."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())))


def request_key(body: Column, model: str = "lexical-1") -> Column:
    """The key under which an answer is kept: it changes with the model and everything that is asked."""
    return F.sha2(F.concat(F.lit(model + "\n"), body), 256)


def question_hash(config: dict) -> str:
    """Sixteen figures that change with what is asked, not with thresholds or layout."""
    asked = {k: v for k, v in config.items() if k not in ("thresholds", "layout", "folders", "ignore")}
    return hashlib.sha256(json.dumps(asked, ensure_ascii=False, sort_keys=True).encode()).hexdigest()[:16]


def shrunk(most: int = 6000, tries: int = 3, least: int = 800) -> list[int]:
    """The lengths at which a request that is too large is tried again."""
    out = [most]
    while len(out) <= tries and out[-1] > least:
        out.append(out[-1] // 2)
    return out


# ---- rules


def level_at(c: Column) -> Column:
    """Place of a level, from 0; null for none."""
    p = F.array_position(F.array(*map(F.lit, LEVELS)), c)
    return F.when(p > 0, p - 1)


def settled(sensitivity: Column, sure: Column, floor: Column, floor_reason: Column, flags: Column, columns: Column, flag_at: float = 0.5) -> Column:
    """Struct (level, raised_from, reasons): a level without evidence lowered, then raised by what was found.

    floor: the level that findings ask for, or null.  flags: struct of personal_data, credentials, payment_details.  columns: array of
    (name, data, confidence).  The level only rises in the second step, in the order floor, credentials, columns.
    """
    z = F.lit(0.0)
    credentials = F.coalesce(flags["credentials"], z)
    most = F.greatest(F.coalesce(flags["personal_data"], z), credentials, F.coalesce(flags["payment_details"], z))
    hot = F.filter(F.coalesce(columns, F.array().cast("array<struct<name:string,data:string,confidence:double>>")), lambda c: c["data"].isin(*RESTRICTED_COLUMNS) & (c["confidence"] >= 0.6))
    evidence = floor.isNotNull() | (F.size(hot) > 0) | (most >= flag_at)
    lowered = F.coalesce((sensitivity == "restricted") & ~evidence & (sure < 0.8), F.lit(False))
    start = F.when(lowered, F.lit("confidential")).otherwise(sensitivity)
    kinds = F.array_join(F.array_distinct(F.transform(hot, lambda c: F.regexp_replace(c["data"], "_", " "))), ", ")
    steps = F.array(
        F.struct(floor.alias("level"), F.concat(F.lit("detected "), floor_reason).alias("why")),
        F.struct(F.when(credentials >= flag_at, F.lit("restricted")).alias("level"), F.lit("contains credentials").alias("why")),
        F.struct(F.when(F.size(hot) > 0, F.lit("restricted")).alias("level"), F.concat(F.lit("columns with "), kinds).alias("why")),
    )
    first = F.struct(start.alias("level"), F.lit(None).cast("string").alias("raised_from"), F.when(lowered, F.array(F.lit("lowered from restricted: no evidence found"))).otherwise(F.array().cast("array<string>")).alias("reasons"))

    def step(a: Column, x: Column) -> Column:
        up = x["level"].isNotNull() & (F.coalesce(level_at(x["level"]), F.lit(-1)) > F.coalesce(level_at(a["level"]), F.lit(-1)))
        return F.when(up, F.struct(x["level"].alias("level"), F.coalesce(a["raised_from"], a["level"]).alias("raised_from"), F.concat(a["reasons"], F.array(x["why"])).alias("reasons"))).otherwise(a)

    return F.aggregate(steps, first, step)
