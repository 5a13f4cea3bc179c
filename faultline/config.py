"""Parameters every operator takes, as values fixed per run: plans never read the clock."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone


@dataclass(frozen=True)
class EngineConfig:
    """now: the clock of the investigation. offsets: seconds added to the times of a named source. mode: interactive or auto. max_chars: room of a rendered
    summary. max_line_chars, max_record_lines, max_message_chars: bounds of lines, records and messages of several lines, for results equal to tools that cut
    them (8192, 60 and 4000 there); none by default, whole texts."""

    now: datetime = datetime(2026, 7, 28, 20, 0)
    mode: str = "interactive"
    max_chars: int = 12_000
    max_lines: int = 0
    max_line_chars: int | None = None
    max_record_lines: int | None = None
    max_message_chars: int | None = None
    offsets: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.mode not in ("interactive", "auto"):
            raise ValueError(f"unknown mode {self.mode}")
        if isinstance(self.now, str):
            object.__setattr__(self, "now", parse_now(self.now))

    @property
    def now_us(self) -> int:
        return int((self.now - datetime(1970, 1, 1)).total_seconds() * 1_000_000)


_BACK = re.compile(r"-?(\d+)\s*([smhd])", re.I)
_UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days"}


def parse_time(text: str, now: datetime) -> datetime:
    """A moment from an argument: a span back from `now` (45s, 30m, 1h, 2d), a clock time of the day of `now` (12:10, 12:10:30), or a date with or without a time, in UTC if it
    names an offset. Anything else is an error."""
    t = text.strip()
    if m := _BACK.fullmatch(t):
        return now - timedelta(**{_UNITS[m.group(2).lower()]: int(m.group(1))})
    for form in ("%H:%M", "%H:%M:%S"):
        try:
            return datetime.combine(now.date(), datetime.strptime(t, form).time())
        except ValueError:
            pass
    for form in ("%d.%m.%Y %H:%M:%S", "%d.%m.%Y %H:%M", "%d.%m.%Y", "%d/%b/%Y:%H:%M:%S %z", "%d/%b/%Y:%H:%M:%S"):
        try:
            at = datetime.strptime(t, form)
            break
        except ValueError:
            pass
    else:
        try:
            at = datetime.fromisoformat(t.replace("/", "-").replace(",", "."))
        except ValueError:
            raise ValueError(f"no time: {text}") from None
    return at.astimezone(timezone.utc).replace(tzinfo=None) if at.tzinfo else at


def parse_now(text: str) -> datetime:
    """The clock from text in one of five forms."""
    for form in ("%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%dT%H:%M", "%Y-%m-%d"):
        try:
            return datetime.strptime(text.strip(), form)
        except ValueError:
            pass
    raise ValueError(f"no time: {text}")
