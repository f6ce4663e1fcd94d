"""Gap fill and lags as SQL table functions over a registered view of daily demand.

The functions are plain SQL of the session, so that features can be built by statements alone:
``SELECT * FROM demand_lagged() WHERE qty_d14 IS NOT NULL``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidecast.config import DATE, QTY

VIEW = "tidecast_demand"


def register_demand(demand: DataFrame, keys: tuple[str, ...], lags: int = 14, view: str = VIEW) -> None:
    """Registers ``demand`` (keys, date, qty) as ``view``, and the table functions demand_filled() and demand_lagged() over it.

    demand_filled has a row for every series and day of the whole range, 0 on days without demand;
    demand_lagged adds qty_d1 to qty_d<lags>, null where a series has no such day. Both plan as
    the operators do: a row spawns the days up to the next one, no grid is joined.
    """
    spark = demand.sparkSession
    demand.createOrReplaceTempView(view)
    kinds = {f.name: f.dataType.simpleString() for f in demand.schema}
    names, schema = ", ".join(f"`{k}`" for k in keys), ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    window = f"(PARTITION BY {names} ORDER BY `{DATE}`)"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION demand_filled() RETURNS TABLE ({schema}, `{DATE}` date, `{QTY}` bigint) RETURN
        SELECT {names}, day, CAST(if(day = `{DATE}`, `{QTY}`, 0) AS BIGINT) FROM (
          SELECT {names}, `{DATE}`, `{QTY}`, explode(sequence(run_from, run_to)) AS day FROM (
            SELECT {names}, `{DATE}`, `{QTY}`,
              if(lag(`{DATE}`) OVER {window} IS NULL, (SELECT min(`{DATE}`) FROM {view}), `{DATE}`) AS run_from,
              coalesce(date_sub(lead(`{DATE}`) OVER {window}, 1), (SELECT max(`{DATE}`) FROM {view})) AS run_to
            FROM {view}))""")
    columns = ", ".join(f"lag(`{QTY}`, {i}) OVER {window}" for i in range(1, lags + 1))
    lagged = ", ".join(f"`{QTY}_d{i}` bigint" for i in range(1, lags + 1))
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION demand_lagged() RETURNS TABLE ({schema}, `{DATE}` date, `{QTY}` bigint, {lagged}) RETURN
        SELECT {names}, `{DATE}`, `{QTY}`, {columns} FROM demand_filled()""")
