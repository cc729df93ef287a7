"""What the audit says: report lines, log lines, names that are safe to print. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST = "For each line: say it as the contract of what it describes, prove it with a test, or move it to the message of the change."
AGAIN = "As said earlier in this session: rewording changes nothing; the claim has to move."


def printable(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x1f\x7f]", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def display(path: Column, cwd: Column) -> Column:
    """The path below cwd; its last part if it isn't below, or cwd is empty."""
    root = F.concat(F.regexp_replace(cwd, r"/+\z", ""), F.lit("/"))
    below = (cwd != "") & path.startswith(root)
    return printable(F.when(below, F.substring(path, F.char_length(root) + 1, F.char_length(path))).otherwise(basename(path)))


def thousandths(score: Column) -> Column:
    """A double rounded to three places as C's and Go's formatters do: by its exact binary value, a true half to even. Java's
    formatter and round() go by the shortest decimal instead, which may show a half where there is none (0.0125 lies above it)."""
    product = score * 1000.0
    high = score * 134217729.0 - (score * 134217729.0 - score)  # 26 bits, so that products by 1000 are exact
    lost = (high * 1000.0 - product) + (score - high) * 1000.0
    whole = F.rint(product)
    return F.when((F.abs(product - whole) == 0.5) & (lost != 0), product + F.signum(lost) * 0.5).otherwise(whole) / 1000.0


def tsv(path: Column, line: Column, class_: Column, score: Column, reason: Column) -> Column:
    return F.format_string("%s:%d\t%s\t%.3f\t%s", path, line, class_, thousandths(score), reason)


def log_line(at: Column, path: Column, line: Column, class_: Column, score: Column) -> Column:
    return F.to_json(F.struct(at.alias("at"), path.alias("file"), line.alias("line"), class_.alias("class"), score.alias("score")))


def summary(n: Column, name: Column) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, " comment in ").otherwise(" comments in "), name, F.lit(" to look at again"))


def report(name: Column, findings: Column, repeat: Column, rules: Column) -> Column:
    """findings is an array of rank, line and reason. The long instruction comes once in a session, and names the file of
    rules if there is one."""
    lines = F.array_join(F.transform(F.array_sort(findings), lambda f: F.concat(F.lit("  line "), f["line"].cast("string"), F.lit("  "), f["reason"], F.lit("\n"))), "")
    close = F.when(repeat, AGAIN).otherwise(F.concat(F.lit(FIRST), F.when(rules.isNull(), "").otherwise(F.concat(F.lit("\n\nSee "), rules, F.lit(".")))))
    return F.concat(F.lit("Look at "), name, F.lit(" again: these comments say what belongs elsewhere.\n\n"), lines, F.lit("\n"), close)


def hook_result(context: Column, message: Column) -> Column:
    """The answer to a write event."""
    inner = F.struct(F.lit("PostToolUse").alias("hookEventName"), context.alias("additionalContext"))
    return F.to_json(F.struct(inner.alias("hookSpecificOutput"), message.alias("systemMessage")))
