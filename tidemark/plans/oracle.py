"""The views and stages once more in plain SQL, for the engine that results are held against."""

from __future__ import annotations

from tidemark.plans import views

PX = "aoi_id, px_row, px_col"


def low(band: str, threshold: float) -> str:
    x, m, s = band, f"{band}_mean", f"{band}_std"
    return f"(CASE WHEN {x} IS NULL OR {m} IS NULL OR {s} IS NULL THEN NULL WHEN {s} = 0 THEN CASE WHEN {x} < {m} THEN true WHEN {x} > {m} THEN false END ELSE ({x} - {m}) / {s} < {threshold}::DOUBLE END)"


def classes(vv: float, vh: float) -> str:
    return f"SELECT aoi_id, scene_id, obs_date, px_row, px_col, 2 * {low('vv', vv)}::INT + {low('vh', vh)}::INT AS cls FROM wet LEFT JOIN base USING ({PX})"


def horn(cell: float = 30.0) -> str:
    at = lambda r, c: f"max(CASE WHEN n.px_row = d.px_row + {r} AND n.px_col = d.px_col + {c} THEN n.elev END)"
    dx = f"(({at(-1, 1)} + 2 * {at(0, 1)} + {at(1, 1)}) - ({at(-1, -1)} + 2 * {at(0, -1)} + {at(1, -1)}))"
    dy = f"(({at(1, -1)} + 2 * {at(1, 0)} + {at(1, 1)}) - ({at(-1, -1)} + 2 * {at(-1, 0)} + {at(-1, 1)}))"
    return f"""SELECT d.aoi_id, d.px_row, d.px_col, coalesce(degrees(atan(sqrt(pow({dx} / {8 * cell}::DOUBLE, 2) + pow({dy} / {8 * cell}::DOUBLE, 2)))), 0) AS slope_deg
FROM dem d JOIN dem n ON d.aoi_id = n.aoi_id AND n.px_row BETWEEN d.px_row - 1 AND d.px_row + 1 AND n.px_col BETWEEN d.px_col - 1 AND d.px_col + 1 GROUP BY d.aoi_id, d.px_row, d.px_col, d.elev"""


#: Stage -> (stages it reads, SQL).
STAGES: dict[str, tuple[tuple[str, ...], str]] = {
    "obs": ((), views.sql(views.OBS)),
    "dem": ((), views.sql(views.DEM)),
    "areas": ((), views.sql(views.AREAS)),
    "catalog": ((), views.sql(views.CATALOG)),
    "dry": (("obs",), f"SELECT * FROM obs WHERE month(obs_date) IN {views.DRY}"),
    "wet": (("obs",), f"SELECT * FROM obs WHERE month(obs_date) IN {views.WET}"),
    "base": (("dry",), f"SELECT {PX}, avg(vv) AS vv_mean, stddev_pop(vv) AS vv_std, count(vv) AS n_vv, avg(vh) AS vh_mean, stddev_pop(vh) AS vh_std, count(vh) AS n_vh FROM dry GROUP BY {PX}"),
    "classes": (("wet", "base"), classes(-1.5, -1.5)),
    "strict": (("wet", "base"), classes(-2.5, -2.5)),
    "slope": (("dem",), horn()),
    "masked": (("classes", "slope"), f"SELECT c.* EXCLUDE (cls), CASE WHEN slope_deg < 15 THEN cls ELSE 0 END AS cls FROM classes c LEFT JOIN slope USING ({PX})"),
    "dates": (("classes",), f"SELECT {PX}, obs_date, CASE WHEN count(*) = count(cls) THEN max(cls) END AS cls FROM classes GROUP BY {PX}, obs_date"),
    "months": (("dates",), f"SELECT {PX}, strftime(obs_date, '%Y%m') AS ym, CASE WHEN count(cls) = 0 THEN 255 ELSE count(*) FILTER (cls = 3) END::INT AS flood_days FROM dates GROUP BY {PX}, strftime(obs_date, '%Y%m')"),
    "strict_dates": (("strict",), f"SELECT {PX}, obs_date, CASE WHEN count(*) = count(cls) THEN max(cls) END AS cls FROM strict GROUP BY {PX}, obs_date"),
    "strict_months": (("strict_dates",), f"SELECT {PX}, strftime(obs_date, '%Y%m') AS ym, CASE WHEN count(cls) = 0 THEN 255 ELSE count(*) FILTER (cls = 3) END::INT AS flood_days FROM strict_dates GROUP BY {PX}, strftime(obs_date, '%Y%m')"),
    "valid": (("wet",), f"SELECT {PX}, count(*) FILTER (vv IS NOT NULL AND vh IS NOT NULL) AS n_valid FROM wet GROUP BY {PX}"),
    "years": (("dates",), f"SELECT aoi_id, strftime(obs_date, '%Y') AS scene_id, px_row, px_col, max(cls) AS cls FROM dates GROUP BY {PX}, strftime(obs_date, '%Y')"),
    "monthly_scenes": (("obs",), f"SELECT aoi_id, strftime(obs_date, '%Y%m') AS scene_id, px_row, px_col, max(vv) AS vv, max(vh) AS vh FROM obs GROUP BY {PX}, strftime(obs_date, '%Y%m')"),
    "items": (("catalog",), "SELECT *, split_part(scene_id, '_', 4) AS burst, split_part(scene_id, '_', 5) AS taken, split_part(scene_id, '_', 6) AS processed FROM catalog"),
    "newest": (("items",), "SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY burst, taken ORDER BY processed DESC, arrival) = 1"),
    "pairs": (("areas", "newest"), "SELECT a.aoi_id, s.scene_id FROM areas a JOIN newest s ON a.minx <= s.maxx AND a.maxx >= s.minx AND a.miny <= s.maxy AND a.maxy >= s.miny"),
}


def using(body: str, *stages: str, recursive: str = "") -> str:
    """A query over the named stages."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in STAGES[name][0]:
            need(n)
        if name not in order:
            order.append(name)

    for s in stages:
        need(s)
    parts = [f"{n} AS ({STAGES[n][1]})" for n in order] + ([recursive] if recursive else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}"
