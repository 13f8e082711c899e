"""Where a catalogue goes and comes from: JSON lines, a flat CSV, the run's facts, an index, a page, a folder of copies."""

from __future__ import annotations

import hashlib
import html
import json
import os
import shutil
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import catalog as c

DEFAULTS = {
    "company": {"name": "", "aliases": []}, "layout": "{department}/{type}/{year}/{name}", "restricted_separately": True, "date_order": "dmy", "max_chars": 6000,
    "folders": {"review": "_Needs review", "restricted": "_Restricted", "noise": "_Noise", "duplicates": "_Duplicates"}, "thresholds": {"department": 0.6, "type": 0.5, "noise": 0.8, "flag": 0.5, "tag": 0.7}, "labels": {},
}


def load_config(path: str | None = None) -> dict:
    """The defaults under a file's settings: company, folders and thresholds are merged, all else replaced; names that begin with _ are notes."""
    cfg = json.loads(json.dumps(DEFAULTS))
    user = json.loads(Path(path).read_text("utf-8")) if path else {}
    for k, v in user.items():
        if k.startswith("_"):
            continue
        cfg[k] = cfg[k] | v if k in ("company", "folders", "thresholds") and isinstance(v, dict) else v
    for k in ("departments", "types", "sensitivity"):
        if k in cfg and not 2 <= len(cfg[k]) <= 250:
            raise ValueError(f"{k} needs 2 to 250 options, not {len(cfg[k])}")
    if "{name}" not in cfg["layout"] and "{stem}" not in cfg["layout"]:
        raise ValueError("the layout needs {name} or {stem}")
    return cfg


def write_config(path: str) -> None:
    """Writes the defaults, unless there is a file already."""
    if os.path.exists(path):
        raise FileExistsError(path)
    Path(path).write_text(json.dumps(DEFAULTS, indent=2, ensure_ascii=False) + "\n", "utf-8")


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, nulls left out, by path."""
    df.orderBy("path").write.mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """The 24 flat columns; a cell is quoted where it holds a quote, a comma or a line's end, quotes doubled."""
    c.flat(df).orderBy("path").write.mode("overwrite").csv(path, header=True, quote='"', escape='"', nullValue="", emptyValue="")


def run_facts(df: DataFrame, **more: object) -> dict:
    """The run's counts as one dict."""
    out = c.summary(df).first().asDict()
    return out | {"bytes": df.agg(F.sum("size")).first()[0] or 0} | more


def _md(text: object) -> str:
    return str(text if text is not None else "").replace("|", "\\|").replace("\n", " ")


def index_markdown(df: DataFrame, title: str = "Index") -> str:
    """A readable index: counts, departments with their main types, listings of at most 60 files a group, sections of at most 200."""
    live = df.filter(c.live())
    s = c.summary(df).first().asDict()
    out = [f"# {title}", "", ", ".join(f"{v} {k.replace('_', ' ')}" for k, v in s.items()), "", "| Department | Files | Types |", "| --- | ---: | --- |"]
    out += [f"| {_md(r['department'])} | {r['n']} | {_md(r['types'])} |" for r in c.top_types(live).orderBy(F.desc("n"), "department").collect()]
    group = None
    for r in c.listing(live).orderBy("department", "doc_type", "place").toLocalIterator():
        if (r["department"], r["doc_type"]) != group:
            group = (r["department"], r["doc_type"])
            out += ["", f"## {_md(group[0])} / {_md(group[1])}" + (f" (and {r['more']} more)" if r["more"] else ""), ""]
        out.append(f"- {r['doc_date'] or 'undated'} {_md(r['file_name'])}")
    for name in ("review", "restricted", "duplicates", "noise"):
        rows = c.section(df, name).select("path").collect()
        if rows:
            out += ["", f"## {name.capitalize()}", "", *(f"- {_md(r['path'])}" for r in rows)]
    return "\n".join(out) + "\n"


def report_html(df: DataFrame, title: str = "Report", most: int = 5000) -> str:
    """A page with the counts and the first rows by path, which it filters and sorts itself; what the rows hold is no markup in it."""
    rows = [r.asDict() for r in df.orderBy("path").select("path", "department", "doc_type", "sensitivity", "doc_date", "counterparty", "title").limit(most).collect()]
    data = json.dumps(rows, ensure_ascii=False).replace("<", "\\u003c")
    tiles = "".join(f"<li><b>{v}</b> {html.escape(k.replace('_', ' '))}</li>" for k, v in c.tiles(df).first().asDict().items())
    return (
        f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><ul>{tiles}</ul><input id=q placeholder=filter><table id=t></table>"
        f'<script type="application/json" id=d>{data}</script><script>const rows=JSON.parse(d.textContent),keys=Object.keys(rows[0]||{{}});let by=keys[0],up=1;'
        "function cell(tag,text){const e=document.createElement(tag);e.textContent=text??'';return e}"
        "function draw(){const w=q.value.toLowerCase();t.replaceChildren();const h=t.insertRow();keys.forEach(k=>{const e=cell('th',k);e.onclick=()=>{up=by==k?-up:1;by=k;draw()};h.append(e)});"
        "rows.filter(r=>JSON.stringify(Object.values(r)).toLowerCase().includes(w)).sort((a,b)=>up*String(a[by]??'').localeCompare(String(b[by]??''))).forEach(r=>{const x=t.insertRow();keys.forEach(k=>x.append(cell('td',r[k])))})}"
        "q.oninput=draw;draw()</script>\n"
    )


def guide(title: str = "Guide") -> str:
    return f"# {title}\n\nFiles lie in folders by department, type and year. INDEX.md lists them; catalog.jsonl has a line for each with all that is known of it. Originals are not in this folder.\n"


# ---- copies

MODES = ("copy", "link", "symlink")


def _hash(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def _place(src: str, dst: str, size: int, sha: str | None, mode: str) -> tuple[str, str]:
    """(what was done, where the file is): a file that is there with the same content is left, one with another content is never overwritten."""
    if not os.path.exists(src):
        return "missing", dst
    if os.path.exists(dst):
        if os.path.getsize(dst) == size and _hash(dst) == (sha or _hash(src)):
            return "skipped", dst
        base, ext = os.path.splitext(dst)
        n = 2
        while os.path.exists(f"{base} ({n}){ext}"):
            n += 1
        dst = f"{base} ({n}){ext}"
        done = "renamed"
    else:
        done = "copied" if mode == "copy" else "linked"
    os.makedirs(os.path.dirname(dst), exist_ok=True)
    if mode == "symlink":
        os.symlink(src, dst)
    elif mode == "link":
        try:
            os.link(src, dst)
        except OSError:
            shutil.copyfile(src, dst)
    else:
        shutil.copyfile(src, dst + ".part")
        os.replace(dst + ".part", dst)
    return done, dst


def apply_plan(df: DataFrame, source: str, dest: str, mode: str = "copy") -> DataFrame:
    """(path, target, done): each file of df (path, target, size, sha256) copied or linked to its target, by the executors.

    Running it again does nothing.  The targets must differ (:func:`unique_targets`); folders must be seen by all executors.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    a, b = os.path.abspath(source), os.path.abspath(dest)
    if b == a or b.startswith(a + os.sep):
        raise ValueError("the destination must not lie in the source folder")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for p, t, n, h in zip(x["path"], x["target"], x["size"], x["sha256"]):
                done, at = _place(os.path.join(a, p), os.path.join(b, t), int(n), h, mode)
                rows.append((p, os.path.relpath(at, b).replace(os.sep, "/"), done))
            yield pd.DataFrame(rows, columns=["path", "target", "done"])

    os.makedirs(b, exist_ok=True)
    return df.select("path", "target", F.coalesce("size", F.lit(0)).alias("size"), "sha256").mapInPandas(work, "path string, target string, done string")


def log_applied(done: DataFrame, path: str) -> None:
    """Appends what was placed to a log of JSON lines."""
    done.filter("done in ('copied', 'linked', 'renamed')").write.mode("append").json(path)
