"""Name -> query and name -> oracle SQL, gathered from the query modules."""

from __future__ import annotations

from tendril.plans import flows, lookups, matching, metadata, offers, quoting, sheets, texts, workbook

QUERIES: dict = {**quoting.QUERIES, **texts.QUERIES, **lookups.QUERIES, **sheets.QUERIES, **flows.QUERIES, **metadata.QUERIES, **matching.QUERIES, **workbook.QUERIES, **offers.QUERIES}
ORACLES: dict = {**quoting.ORACLES, **texts.ORACLES, **lookups.ORACLES, **sheets.ORACLES, **flows.ORACLES, **metadata.ORACLES, **matching.ORACLES, **workbook.ORACLES, **offers.ORACLES}
