"""Parameters shared by the marts."""

from __future__ import annotations

import calendar
from dataclasses import dataclass
from datetime import date, timedelta

# Transaction kinds of the premium snapshots.
EARNED_TRANS = ("monthly earned premium", "monthly earned premium endorsement")
WRITTEN_TRANS = (
    "New",
    "Renewal",
    "Cancellation - New",
    "Cancellation - Renewal",
    "Undo Cancellation - New",
    "Undo Cancellation - Renewal",
)
INCEPTION_TRANS = ("New", "Renewal")

# Catastrophe codes that do not mark a catastrophe.
NON_CAT_CODES_CLAIMS = (
    "1111/BFA",
    "2212",
    "NRP-X-R-0-0",
    "2222/XOL",
    "CD",
    "SIU",
    "Bad Faith Suit",
    "Bad Faith Suit / SIU",
    "COVID19",
    "1111/BFA and SIU",
    "HSB",
)
NON_CAT_CODES_POLICY = ("1111/BFA", "2212", "NRP-X-R-0-0", "2222/XOL", "CD", "SIU", "Bad Faith Suit")
NON_CAT_FRAGMENTS_CLAIMS = ("subro", "salv")

# Claim administrator with long ids, length of the shared part, crime-score vendor.
TRIMMED_TPA = "Gallagher Bassett"
TRIMMED_LENGTH = 13
CRIME_PROVIDER = "Verisk"


@dataclass(frozen=True)
class MartConfig:
    """One run of the marts.

    ``carriers`` has no default: the companies on whose paper the book is written belong to the
    user.  ``as_of`` stands where a warehouse query would say "today", so a run can be repeated.
    A join key is spread over several tasks when it has more than 1 / ``hot_parts`` of the rows (see ``operators.skew``); by
    default that is an average shuffle partition.  With ``strict_documents`` a text in a rating or quote document that should be a
    number and is none ends the query, and in the rating master a document that is no JSON does too, with an error that
    tells the policy; without, both count as missing.
    """

    carriers: tuple[str, ...]
    as_of: date
    start: date = date(2020, 7, 30)
    rating_through: date = date(2025, 6, 30)
    lob: str = "IM"
    crime_provider: str = CRIME_PROVIDER
    trimmed_tpa: str = TRIMMED_TPA
    hot_parts: int | None = None
    strict_types: bool = False
    strict_documents: bool = False

    def __post_init__(self) -> None:
        if not self.carriers:
            raise ValueError("carriers must name at least one carrier")

    @property
    def through(self) -> date:
        """Last day of the month before ``as_of``."""
        return self.as_of.replace(day=1) - timedelta(days=1)

    @property
    def loss_from(self) -> date:
        """First accident date of the coverage mart."""
        return self.start


def month_end(d: date) -> date:
    return d.replace(day=calendar.monthrange(d.year, d.month)[1])
