"""Read-only SQL over named views: Spark's own parser and analyser say what a statement is, and a guard refuses the rest."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.aggregates import is_empty_result, rounded

ROW_LIMIT, SUMMARY_ROWS, MERCHANTS_LISTED, SECONDS = 500, 50, 150, 3.0
#: Characters of a statement, and seconds that its analysis and its plan may take, which no job is there to be cancelled for.
LONGEST, PLANNING = 20_000, 10.0
#: What would be computed while planning, on the driver: in a session of its own it waits for a task.
_FOLDING = ",".join(f"org.apache.spark.sql.catalyst.optimizer.{r}" for r in ("ConstantFolding", "ConvertToLocalRelation", "OptimizeOneRowPlan"))
#: Plan nodes that may stand over the one SELECT, and nodes that are one.
OVER = {"Sort", "GlobalLimit", "LocalLimit", "Offset", "UnresolvedHaving", "UnresolvedWith", "Distinct", "SubqueryAlias", "WithWindowDefinition"}
SELECTS = {"Project", "Aggregate"}
#: What a plan may read besides the views, once analysed: nothing at all, literal rows, and its own WITH.
LEAVES = {"OneRowRelation", "LocalRelation", "CTERelationRef"}
#: Expressions that reach files or the JVM, and those that make values of any size out of a few characters.
BARRED = {
    "CallMethodViaReflection", "TryReflect", "InputFileName", "InputFileBlockStart", "InputFileBlockLength", "PythonUDF", "ScalaUDF",
    "Sequence", "ArrayRepeat", "StringRepeat", "StringSpace",
}


class Refused(ValueError):
    """The statement is no single read-only SELECT over the views."""


def strip_fences(sql: str) -> str:
    found = re.fullmatch(r"\s*```(?:sql)?\s*(.*?)```\s*", sql, re.S | re.I)
    return (found.group(1) if found else sql).strip().rstrip(";").strip()


def _name(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _each(sequence) -> Iterator:
    it = sequence.iterator()
    while it.hasNext():
        yield it.next()


def _nodes(plan) -> Iterator:
    """All nodes of a plan, those of CTEs and subqueries too."""
    yield plan
    for child in _each(plan.children()):
        yield from _nodes(child)
    for inner in _each(plan.innerChildren()):
        if hasattr(inner, "subqueries"):
            yield from _nodes(inner)
    for sub in _each(plan.subqueries()):
        yield from _nodes(sub)


def _reads(plan) -> Iterator:
    """What an analysed plan reads: the views by name, without looking into them, and the kinds of all other leaves."""
    if _name(plan) == "View":
        yield True, plan.desc().identifier().table().lower()
        return
    below = [*_each(plan.children()), *_each(plan.subqueries())]
    if not plan.children().size():
        yield False, _name(plan)
    for node in below:
        yield from _reads(node)


def _expressions(node) -> Iterator:
    def under(e):
        yield e
        for child in _each(e.children()):
            yield from under(child)

    for e in _each(node.expressions()):
        yield from under(e)


@contextmanager
def isolated(spark: SparkSession, **views: DataFrame) -> Iterator[SparkSession]:
    """A session that has these views and nothing else of the caller's: not its views, functions or settings. The caller's
    own views stay as they are. Constants are not computed while planning there."""
    inner, shared = spark.newSession(), []
    try:
        for name, df in views.items():
            shared.append(f"ask_{uuid.uuid4().hex}")
            df.createGlobalTempView(shared[-1])
            inner.sql(f"CREATE TEMPORARY VIEW {name} AS SELECT * FROM global_temp.{shared[-1]}")
        inner.conf.set("spark.sql.optimizer.excludedRules", _FOLDING)
        yield inner
    finally:
        for name in shared:
            spark.catalog.dropGlobalTempView(name)


def _within(seconds: float, work: Callable):
    """What work gives; Refused if it takes longer. The thread it runs in is not waited for."""
    done: list = []

    def run() -> None:
        try:
            done.append((work(), None))
        except BaseException as failed:
            done.append((None, failed))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if not done:
        raise Refused(f"the statement could not be planned within {seconds:g} seconds")
    if done[0][1] is not None:
        raise done[0][1]
    return done[0][0]


def check(spark: SparkSession, sql: str, views: tuple[str, ...]) -> str:
    """The statement without fences, if it is one SELECT over the views alone; Refused otherwise. Top-level UNION,
    parentheses around the whole, commands, paths as tables, and functions that reach files or the JVM are refused."""
    sql = strip_fences(sql)
    if len(sql) > LONGEST:
        raise Refused(f"a statement has at most {LONGEST} characters")
    if not re.match(r"(?i)(select|with)\b", re.sub(r"(?s)^(\s*(--[^\n]*\n|/\*.*?\*/))*\s*", "", sql)):
        raise Refused("only SELECT is allowed")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as bad:
        raise Refused(f"not one SQL statement: {type(bad).__name__}") from bad
    top = plan
    while _name(top) in OVER:
        top = top.children().apply(0)
    if _name(top) not in SELECTS:
        raise Refused("only a single SELECT is allowed")
    allowed = {v.lower() for v in views}
    for node in _nodes(plan):
        if _name(node) == "UnresolvedWith":
            allowed |= {pair._1().lower() for pair in _each(node.cteRelations())}
    for node in _nodes(plan):
        kind = _name(node)
        if kind in ("UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "PlanWithUnresolvedIdentifier") or kind.endswith("Command") or kind.startswith("Insert"):
            raise Refused(f"{kind} is not allowed")
        if kind == "UnresolvedRelation" and node.tableName().replace("`", "").lower() not in allowed:
            raise Refused(f"unknown table {node.tableName()}")
    analysed = spark.sql(sql)._jdf.queryExecution().analyzed()
    for is_view, name in _reads(analysed):
        if name not in ({v.lower() for v in views} if is_view else LEAVES):
            raise Refused(f"{name} is not one of the views")
    for node in _nodes(analysed):
        for e in _expressions(node):
            if _name(e) in BARRED:
                raise Refused(f"{_name(e)} is not allowed")
    return sql


def run(spark: SparkSession, sql: str, views: tuple[str, ...], *, limit: int = ROW_LIMIT, seconds: float = SECONDS) -> list[dict]:
    """Rows of a checked statement, its floats rounded, `limit` at most; planning may take PLANNING seconds, and its job is
    cancelled after `seconds`."""

    def planned() -> DataFrame:
        df = rounded(spark.sql(check(spark, sql, views)).limit(limit))
        df._jdf.queryExecution().executedPlan()
        return df

    df = _within(PLANNING, planned)
    group = f"ask-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, "ask", interruptOnCancel=True)
    timer = threading.Timer(seconds, lambda: spark.sparkContext.cancelJobGroup(group))
    timer.start()
    try:
        return [row.asDict(recursive=True) for row in df.collect()]
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def inventory(accounts: DataFrame, txns: DataFrame) -> dict:
    """What a generator is told of the data: accounts, and merchants unless there are too many."""
    names = [r[0] for r in txns.where(F.col("merchant").isNotNull()).select("merchant").distinct().limit(MERCHANTS_LISTED + 1).collect()]
    heads = [r.asDict() for r in accounts.select("id", "bank_name", "account_type").limit(MERCHANTS_LISTED).collect()]
    return {"accounts": heads, "merchants": sorted(names) if len(names) <= MERCHANTS_LISTED else []}


def prompt(question: str, known: dict, error: str | None = None) -> str:
    """Instructions for a generator of SQL."""
    lines = [
        "Write one Spark SQL SELECT over the views transactions and accounts that answers the question.",
        "amount is negative for money out and positive for money in; report spending as positive.",
        "Leave out rows where is_transfer is true unless the question is about transfers.",
        "Match merchants with ILIKE '%name%'. Use date_format(date, 'yyyy-MM') for months.",
        f"Accounts: {known['accounts']}",
    ]
    if known["merchants"]:
        lines.append(f"Merchants: {', '.join(known['merchants'])}")
    if error:
        lines.append(f"The last statement failed: {error}")
    return "\n".join([*lines, f"Question: {question}"])


_SPENT = "NOT coalesce(is_transfer, false) AND amount < 0"
#: Answers that need no generator.
TEMPLATES = {
    "How much did I spend in each category?": f"SELECT coalesce(nullif(category, ''), 'Other') AS category, -sum(amount) AS spent FROM transactions WHERE {_SPENT} GROUP BY 1 ORDER BY 2 DESC",
    "What were my largest purchases?": f"SELECT date, merchant, -amount AS spent FROM transactions WHERE {_SPENT} ORDER BY amount, id LIMIT 10",
    "How does my spending change from month to month?": f"SELECT date_format(date, 'yyyy-MM') AS month, -sum(amount) AS spent FROM transactions WHERE {_SPENT} GROUP BY 1 ORDER BY 1",
    "Do I spend more on weekends?": f"SELECT dayofweek(date) IN (1, 7) AS weekend, -sum(amount) AS spent, count(*) AS purchases FROM transactions WHERE {_SPENT} GROUP BY 1",
}


@dataclass
class Answer:
    answer: str
    sql: str | None = None
    rows: list[dict] = field(default_factory=list)


def by_template(text: str) -> dict:
    question = text.rsplit("Question: ", 1)[-1].strip()
    found = TEMPLATES.get(question)
    return {"sql": found} if found else {"refusal": "No statement is known for this question."}


def _plain_summary(question: str, rows: list[dict]) -> str:
    return f"{len(rows)} rows; the first: " + ", ".join(f"{k} {v}" for k, v in rows[0].items())


def ask(
    spark: SparkSession, question: str, accounts: DataFrame, txns: DataFrame, *,
    generate: Callable[[str], dict] = by_template, summarize: Callable[[str, list[dict]], str] = _plain_summary,
) -> Answer:
    """A question's statement, rows and summary. generate takes a prompt and gives {sql} or {refusal}; a statement that
    fails is asked for once more with the error. Statements run in a session of their own. Never raises for what a
    generator or a summary does."""
    sql, error, rows = None, None, None
    try:
        known = inventory(accounts, txns)
        with isolated(spark, accounts=accounts, transactions=txns) as inner:
            for _ in range(2):
                reply = generate(prompt(question, known, error))
                if reply.get("refusal"):
                    return Answer(reply["refusal"], sql)
                sql = reply.get("sql") or ""
                try:
                    rows = run(inner, sql, ("transactions", "accounts"))
                    break
                except (Refused, PySparkException) as bad:
                    error = str(bad).splitlines()[0]
                except Exception as bad:  # a cancelled job
                    error = type(bad).__name__
    except Exception as bad:
        return Answer(f"No statement could be written: {type(bad).__name__}.", sql)
    if rows is None:
        return Answer(f"The statement could not be run: {error}", sql)
    if not any(v is not None for r in rows for v in r.values()):
        return Answer("There are no matching data.", sql, [])
    try:
        return Answer(summarize(question, rows[:SUMMARY_ROWS]), sql, rows)
    except Exception:
        return Answer(f"{len(rows)} rows.", sql, rows)


__all__ = ["Answer", "Refused", "ask", "check", "inventory", "is_empty_result", "isolated", "prompt", "run", "strip_fences"]
