"""Map packages: style files, scripts and the files of a network's export. Text templates; tables come from `exports`."""

from __future__ import annotations

from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

from . import exports as X


def style(kind: str, color: str = "31,120,180,255", size: float = 0.6, label: str | None = None) -> str:
    """A map style (QML) of one symbol for lines or points, with labels from a field if one is named."""
    if kind not in ("line", "point"):
        raise ValueError(f"unknown kind of layer {kind!r}")
    layer, width = ("SimpleLine", "line_width") if kind == "line" else ("SimpleMarker", "size")
    colour = "line_color" if kind == "line" else "color"
    props = "".join(f'<Option type="QString" name="{k}" value="{v}"/>' for k, v in ((colour, color), (width, size)))
    labels = f'<labeling type="simple"><settings><text-style fieldName="{escape(label)}" fontSize="8"/></settings></labeling>' if label else ""
    return (
        "<!DOCTYPE qgis PUBLIC 'http://mrcc.com/qgis.dtd' 'SYSTEM'>\n"
        f'<qgis version="3.0" styleCategories="Symbology|Labeling"><renderer-v2 type="singleSymbol"><symbols><symbol type="{"line" if kind == "line" else "marker"}" name="0">'
        f'<layer class="{layer}"><Option type="Map">{props}</Option></layer></symbol></symbols></renderer-v2>{labels}</qgis>\n'
    )


def layer_script(layers: dict[str, str]) -> str:
    """A Python script for a map program that adds each GeoJSON file (name -> file beside the script) with its style."""
    files = ",\n".join(f"    {name!r}: {file!r}" for name, file in sorted(layers.items()))
    return (
        "import os\n\nfrom qgis.core import QgsProject, QgsVectorLayer\n\n"
        "HERE = os.path.dirname(os.path.abspath(__file__))\n"
        f"LAYERS = {{\n{files}\n}}\n\n"
        "for name, file in LAYERS.items():\n"
        "    layer = QgsVectorLayer(os.path.join(HERE, file), name, 'ogr')\n"
        "    if not layer.isValid():\n"
        "        print('not loaded:', name)\n"
        "        continue\n"
        "    look = os.path.join(HERE, os.path.splitext(file)[0] + '.qml')\n"
        "    if os.path.exists(look):\n"
        "        layer.loadNamedStyle(look)\n"
        "    QgsProject.instance().addMapLayer(layer)\n"
        "    print('loaded:', name, layer.featureCount())\n"
    )


def readme(project: str, layers: dict[str, str]) -> str:
    rows = "\n".join(f"- {name}: {file}" for name, file in sorted(layers.items()))
    return f"Map layers of {project}\n\n{rows}\n\nRun load_layers.py in the map program's Python console, or add the GeoJSON files by hand; styles load with them.\n"


def network_package(lines: DataFrame, coordinates: DataFrame, folder: str, project: str = "Leveling Network") -> dict[str, str]:
    """Writes lines and points as GeoJSON, a style of each, the script and a readme; returns layer name -> file."""
    at = Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    from pyspark.sql import functions as F

    X.write_geojson(X.geojson_lines(lines, coordinates), str(at / "lines.geojson"), f"{project} lines")
    ends = lines.filter("is_used").select(F.explode(F.array("start_point", "end_point")).alias("point_id"))
    X.write_geojson(X.geojson_points(ends, coordinates), str(at / "points.geojson"), f"{project} points")
    layers = {"lines": "lines.geojson", "points": "points.geojson"}
    (at / "lines.qml").write_text(style("line", label="filename"), encoding="utf-8")
    (at / "points.qml").write_text(style("point", color="227,26,28,255", size=2.5, label="point_id"), encoding="utf-8")
    (at / "load_layers.py").write_text(layer_script(layers), encoding="utf-8")
    (at / "README.txt").write_text(readme(project, layers), encoding="utf-8")
    return layers


def export_results(lines: DataFrame, observations: DataFrame, coordinates: DataFrame, folder: str, project: str = "project") -> None:
    """The used lines' results: FTEG rows and GeoJSON beside each other."""
    at = Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    X.write_text(X.fteg(observations, only_used=True), str(at / f"{project}.fteg"))
    X.write_geojson(X.geojson_lines(lines, coordinates), str(at / f"{project}.geojson"), project)
