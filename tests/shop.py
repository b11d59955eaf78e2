"""A small shop whose results can be worked out by hand.

Five stores, two items. Dates, quantities and gaps are stated as data; the files are written from them.
"""

from __future__ import annotations

import csv
from datetime import date, timedelta

# The shop's master data.
STORES = [(1, "Quito", "Pichincha", "A", 1), (2, "Quito", "Pichincha", "B", 2), (3, "Guayaquil", "Guayas", "A", 3),
          (4, "Guayaquil", "Guayas", "D", 4), (5, "Cuenca", "Azuay", "C", 5)]
ITEMS = [(101, "GROCERY I", 1001, 0), (102, "PRODUCE", 2001, 1)]
HOLIDAYS = [
    ("2016-01-01", "Holiday", "National", "Ecuador", "New year", False),
    ("2016-02-08", "Holiday", "National", "Ecuador", "Carnival", True),
    ("2016-02-09", "Transfer", "National", "Ecuador", "Carnival moved", False),
    ("2016-03-05", "Holiday", "Local", "Quito", "Foundation", False),
]
# Daily sales as (store, item, first day, last day, units, promotion flag).
SALES = [
    (1, 101, "2015-01-01", "2016-03-31", 5, False),
    (1, 102, "2015-11-01", "2016-03-31", 2, False),
    (2, 101, "2015-06-01", "2015-12-31", 1, False),
    (2, 101, "2016-01-01", "2016-03-31", 1, None),
    (3, 101, "2016-01-01", "2016-01-31", 2, False),
    (4, 101, "2016-01-01", "2016-01-31", 1, False),
    (5, 101, "2016-01-01", "2016-01-31", 1, False),
]
CLOSED = "2015-12-25"      # store 1 has no receipts and sells nothing
PARTIAL = "2016-03-01"     # store 1 has a fifth of its receipts
NO_SALE = {(1, 101): ["2015-12-15", "2016-01-01", "2016-02-10", PARTIAL, CLOSED], (1, 102): ["2015-12-20", CLOSED]}
PROMOTED = ["2016-01-10", "2016-01-11", "2016-01-12"]   # store 1, item 102 sells 6 a day
RETURNED = (2, 101, "2016-01-05")                       # one unit comes back, none is sold
RECEIPTS = [(1, "2015-01-01", "2016-03-31", 100), (2, "2015-06-01", "2016-03-31", 80),
            (3, "2016-01-01", "2016-01-31", 90), (4, "2016-01-01", "2016-01-31", 40), (5, "2016-01-01", "2016-01-31", 30)]


def calendar(first: str, last: str) -> list[str]:
    start, end = date.fromisoformat(first), date.fromisoformat(last)
    return [(start + timedelta(days=i)).isoformat() for i in range((end - start).days + 1)]


def sale_rows():
    for store, item, first, last, units, flag in SALES:
        for day in calendar(first, last):
            if day in NO_SALE.get((store, item), ()):
                continue
            if (store, item) == (1, 102) and day in PROMOTED:
                yield day, store, item, 6.0, True
            elif (store, item, day) == RETURNED:
                yield day, store, item, -1.0, flag
            else:
                yield day, store, item, float(units), flag


def receipt_rows():
    for store, first, last, receipts in RECEIPTS:
        for day in calendar(first, last):
            if store == 1 and day == CLOSED:
                continue
            yield day, store, 20 if store == 1 and day == PARTIAL else receipts


def write_shop(folder) -> str:
    files = {
        "train": (["id", "date", "store_nbr", "item_nbr", "unit_sales", "onpromotion"],
                  [(i, *row[:4], "" if row[4] is None else row[4]) for i, row in enumerate(sale_rows())]),
        "transactions": (["date", "store_nbr", "transactions"], receipt_rows()),
        "stores": (["store_nbr", "city", "state", "type", "cluster"], STORES),
        "items": (["item_nbr", "family", "class", "perishable"], ITEMS),
        "holidays_events": (["date", "type", "locale", "locale_name", "description", "transferred"], HOLIDAYS),
    }
    for name, (header, rows) in files.items():
        with open(folder / f"{name}.csv", "w", newline="", encoding="utf-8") as f:
            writer = csv.writer(f, lineterminator="\n")
            writer.writerow(header)
            writer.writerows(rows)
    return str(folder)
