"""Catalogue search from staged responses to the feeds to process."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame

from tramline.operators import catalog


def search(
    entries: DataFrame,
    target_date: datetime.date,
    extent: str | None = None,
    pref_name: str | None = None,
    stops: DataFrame | None = None,
) -> DataFrame:
    """The result table of a search: 21 columns, see `catalog.catalog_visible` for those shown."""
    found = catalog.catalog_search(entries, target_date, extent, catalog.pref_code(pref_name), stops)
    return catalog.catalog_table(catalog.add_pref_name(found))


def feeds_to_process(table: DataFrame, selection: DataFrame) -> DataFrame:
    """Manifest of the selected rows of a result table."""
    return catalog.feed_manifest(catalog.catalog_feed_infos(catalog.catalog_selected(table, selection)))
