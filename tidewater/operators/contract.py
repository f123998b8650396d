"""A row contract as a list of rules: rows are split into valid ones and invalid ones with all their errors."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """What a field must be. Errors are found in this order, at most one for a field: type, length, `check`."""

    name: str
    kind: str = "string"  # string, double or datetime
    optional: bool = False
    least: int = 0  # characters
    check: object = None  # Column -> Column, true if good
    message: str = ""

    def error(self, c: Column) -> Column:
        missing = {"string": ("string_type", "Input should be a valid string"), "double": ("float_type", "Input should be a valid number"), "datetime": ("datetime_type", "Input should be a valid datetime")}[self.kind]
        shown = c.cast("string")
        none = c.isNull() | F.isnan(c) if self.kind == "double" else c.isNull()

        def of(type_: str, message: str | Column) -> Column:
            text = F.lit(message) if isinstance(message, str) else message
            return F.struct(F.lit(self.name).alias("field"), F.lit(type_).alias("type"), text.alias("message"), shown.alias("input"))

        out = F.when(none, F.lit(None) if self.optional else of(*missing))
        if self.least:
            out = out.when(F.length(c) < self.least, of("string_too_short", f"String should have at least {self.least} character{'s' * (self.least != 1)}"))
        if self.kind == "datetime":
            out = out.when(F.try_to_timestamp(shown).isNull(), of("datetime_from_date_parsing", "Input should be a valid datetime or date"))
        if self.check is not None:
            out = out.when(~self.check(c), of("value_error", F.concat(F.lit(f"Value error, {self.message}: "), F.coalesce(shown, F.lit("None")))))
        return out


def one_of(*words: str):
    """Membership without regard to case; the text isn't trimmed."""
    return lambda c: F.lower(c).isin(*words)


#: Closed vocabularies, the range of a plausible cost, and what an e-mail address looks like.
PRIORITIES = ("low", "medium", "high", "critical")
STATUSES = ("open", "pending", "resolved", "closed")
CATEGORIES = ("billing", "technical", "account", "bug report", "feature request")
LEAST_COST, MOST_COST = -100_000, 1_000_000
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


@dataclass(frozen=True)
class Contract:
    name: str
    rules: tuple[Rule, ...] = field(default_factory=tuple)

    def errors(self) -> Column:
        """All errors of a row, in the order of the rules."""
        return F.array_compact(F.array(*[r.error(F.col(r.name)) for r in self.rules]))

    def annotate(self, df: DataFrame) -> DataFrame:
        return df.withColumn("errors", self.errors())

    def rendered(self, errors: Column) -> Column:
        """Errors as text: a line with their number, then for each a line with the field and an indented one with the reason."""
        n = F.size(errors)
        head = F.concat(n.cast("string"), F.when(n == 1, " validation error for ").otherwise(" validation errors for "), F.lit(self.name))
        shown = F.transform(errors, lambda e: F.concat(e["field"], F.lit("\n  "), e["message"], F.lit(" [type="), e["type"], F.lit(", input_value="), F.coalesce(e["input"], F.lit("None")), F.lit("]")))
        return F.concat_ws("\n", head, shown)

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(valid, invalid): invalid rows keep their values and get `errors` and `validation_error`; no row is lost."""
        noted = self.annotate(df)
        invalid = noted.where(F.size("errors") > 0).withColumn("validation_error", self.rendered(F.col("errors")))
        return noted.where(F.size("errors") == 0).drop("errors"), invalid


TICKETS = Contract(
    "CleanTicket",
    (
        Rule("ticket_id", least=1),
        Rule("company_name", least=2),
        Rule("customer_email", least=1, check=lambda c: F.rlike(c, F.lit(EMAIL)), message="not an e-mail address"),
        Rule("created_at", kind="datetime"),
        Rule("resolved_at", kind="datetime", optional=True),
        Rule("priority", least=1, check=one_of(*PRIORITIES), message="unknown priority"),
        Rule("status", least=1, check=one_of(*STATUSES), message="unknown status"),
        Rule("category", least=1, check=one_of(*CATEGORIES), message="unknown category"),
        Rule("agent_name", least=2),
        Rule("cost", kind="double", check=lambda c: c.between(LEAST_COST, MOST_COST), message="implausible cost"),
    ),
)
