"""The twelve rows that the golden tests work out by hand."""

import datetime as dt


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(f"2025-03-{text}")


GOLDEN = [
    (1, at("01 23:56"), 1, 1, 10.0),
    (2, at("01 23:57"), 1, 1, 12.0),
    (3, at("01 23:58"), 0, 1, 20.0),
    (4, at("01 23:59"), 0, 1, None),
    (5, at("02 00:00"), 0, 1, 22.0),
    (6, at("02 00:01"), 1, 0, 11.0),
    (7, at("02 00:02"), 0, 0, 5.0),
    (8, at("02 00:03"), 0, 0, 6.0),
    (9, at("02 00:04"), 1, 1, 14.0),
    (10, at("02 00:05"), 2, 1, 90.0),
    (11, at("02 00:06"), 0, 1, 24.0),
    (12, at("02 00:06"), 0, 1, 26.0),
]
