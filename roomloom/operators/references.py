"""Foreign keys of the master tables: orphans and cascading deletes along them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Child, parent and the columns by which the child names its parent; parents come first.
FOREIGN_KEYS = (
    ("room", "branch", ("business_id",)),
    ("room_image", "room", ("business_id", "biz_item_id")),
)


def _without_parent(child: DataFrame, parent: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows of ``child`` whose key ``parent`` lacks; keys with a null part refer to nothing."""
    named = child.filter(" and ".join(f"`{k}` is not null" for k in keys))
    return named.join(parent.select(*keys), list(keys), "left_anti")


def orphans(tables: dict[str, DataFrame], keys=FOREIGN_KEYS) -> dict[str, DataFrame]:
    """For each child table the rows whose parent is missing in the given tables."""
    return {child: _without_parent(tables[child], tables[parent], on) for child, parent, on in keys if child in tables and parent in tables}


def cascade(tables: dict[str, DataFrame], deleted: dict[str, DataFrame], keys=FOREIGN_KEYS) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """What stays of each table, and what goes, when the rows ``deleted`` of some tables go.

    ``deleted`` holds rows with at least the columns by which others name them; rows of a child
    go with their parents, theirs with them.  Tables are walked parents first, so each is read once.
    """
    gone = dict(deleted)
    for child, parent, on in keys:
        if child not in tables or parent not in gone:
            continue
        falls = tables[child].join(gone[parent].select(*on).distinct(), list(on), "left_semi")
        own = tuple(c for c in falls.columns if child not in gone or c in gone[child].columns)
        gone[child] = falls.select(*own).unionByName(gone[child].select(*own)) if child in gone else falls
    stays = {}
    for name, table in tables.items():
        if name not in gone:
            stays[name] = table
            continue
        on = [c for c in gone[name].columns if c in table.columns]
        t, g = table.alias("t"), gone[name].select(*on).distinct().alias("g")
        stays[name] = t.join(g, [F.col(f"t.`{c}`").eqNullSafe(F.col(f"g.`{c}`")) for c in on], "left_anti")
    return stays, {name: df for name, df in gone.items() if name in tables}
