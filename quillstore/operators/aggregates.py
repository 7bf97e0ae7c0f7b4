"""Aggregates and window functions by their MySQL names, as Spark SQL."""

from __future__ import annotations

from ..functions import info

#: Functions of a window that take no frame.
NO_FRAME = frozenset("row_number rank dense_rank cume_dist percent_rank ntile lead lag".split())


def aggregate_sql(name: str, args: list[str], distinct: bool = False, order: list[str] | None = None, separator: str = "','") -> str:
    """The Spark SQL of an aggregate call.

    Rows with a NULL argument don't count; bit aggregates of no rows are all ones (and)
    or 0 (or, xor); group_concat of no rows is NULL and is cut at the
    session's group_concat_max_len; of equal keys of json_objectagg the last one met counts.
    """
    unique = "DISTINCT " if distinct else ""
    if name == "count":
        return f"count({unique}{', '.join(args)})"
    if name in ("sum", "avg", "min", "max", "var_pop", "stddev_pop", "approx_count_distinct"):
        return f"{name}({unique}{args[0]})"
    if name in ("std", "stddev"):
        return f"stddev_pop({args[0]})"
    if name == "bit_and":
        return f"coalesce(bit_and({args[0]}), -1)"
    if name in ("bit_or", "bit_xor"):
        return f"coalesce({name}({args[0]}), 0)"
    if name == "group_concat":
        value = f"CAST({args[0]} AS STRING)" if len(args) == 1 else "concat(" + ", ".join(f"CAST({a} AS STRING)" for a in args) + ")"
        key = order or ([value] if distinct else [])
        within = f" WITHIN GROUP (ORDER BY {', '.join(key)})" if key else ""
        return f"left(listagg({unique}{value}, {separator}){within}, {int(info.scope().system['group_concat_max_len'])})"
    if name == "json_objectagg":
        entries = f"transform(collect_list(struct(CAST({args[0]} AS STRING) AS k, {args[1]} AS v)), (q_e, q_i) -> struct(q_e.k AS k, q_i AS i, q_e.v AS v))"
        # The sorted entries are bound as q_l, so that looking at a neighbour doesn't sort anew.
        last = f"transform(array(array_sort({entries})), q_l -> filter(q_l, (q_e, q_i) -> q_i = size(q_l) - 1 OR get(q_l, q_i + 1).k <> q_e.k))[0]"
        return f"to_json(map_from_entries(transform({last}, q_e -> struct(q_e.k, q_e.v))))"
    if name in ("first_row", "any_value"):
        return f"any_value({args[0]})"
    return f"{name}({', '.join(args)})"
