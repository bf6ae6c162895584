"""Click-log reports over the wide ``hits`` view.

A report is data: filter, keys, measures, order. The same description builds the DataFrame and
the checking SQL. Every top-k order ends with the group keys, so results have no ties.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.relational import limited_in_full
from tessera.plans.registry import query

# One expression for both engines, or a (Spark, checking SQL) pair.
Expr = str | tuple[str, str]


def _pick(e: Expr, side: int) -> str:
    return e if isinstance(e, str) else e[side]


def total(col: str) -> str:
    return f"cast(sum({col}) as bigint)"


def mean(col: str) -> str:
    return f"round(avg({col}), 6)"


USERS = "count(distinct UserID)"
ROWS = "count(*)"


@dataclass(frozen=True)
class Report:
    keys: dict[str, Expr] = field(default_factory=dict)
    measures: dict[str, str] = field(default_factory=dict)
    where: str = "true"
    having: str = ""
    order: tuple[str, ...] = ()
    limit: int = 0
    offset: int = 0

    def _order(self) -> list[str]:
        named = [o.split()[0] for o in self.order]
        return [*self.order, *(k for k in self.keys if k not in named)]

    def frame(self, hits: DataFrame) -> DataFrame:
        rows = hits.where(self.where)
        for name, e in self.keys.items():
            if _pick(e, 0) != name:
                rows = rows.withColumn(name, F.expr(_pick(e, 0)))
        if self.measures:
            out = rows.groupBy(*self.keys).agg(
                *[F.expr(e).alias(n) for n, e in self.measures.items()]
            )
            out = out.where(self.having) if self.having else out
        else:
            out = rows
        if self.order:
            out = out.orderBy(
                *[F.desc(o.split()[0]) if o.endswith(" desc") else F.asc(o) for o in self._order()]
            )
        out = out.offset(self.offset) if self.offset else out
        out = out.limit(self.limit) if self.limit else out
        return out if self.measures else out.select(*self.keys)

    def sql(self) -> str:
        cols = [f"{_pick(e, 1)} as {n}" for n, e in {**self.keys, **self.measures}.items()]
        s = f"select {', '.join(cols)} from {{hits}} where {self.where}"
        if self.measures and self.keys:
            s += " group by " + ", ".join(str(i + 1) for i in range(len(self.keys)))
        s += f" having {self.having}" if self.having else ""
        s += f" order by {', '.join(self._order())}" if self.order else ""
        s += f" limit {self.limit}" if self.limit else ""
        return s + (f" offset {self.offset}" if self.offset else "")


def cols(*names: str) -> dict[str, Expr]:
    return {n: n for n in names}


def top(keys: dict, where: str = "true", by: str = "c desc", limit: int = 10, offset: int = 0,
        having: str = "", **measures: str) -> Report:
    return Report(keys, measures or {"c": ROWS}, where, having, (by,), limit, offset)


PHRASE = "SearchPhrase <> ''"
JANUARY = "CounterID = 62 and EventDate between date '2024-01-01' and date '2024-01-31'"
VISIT = f"{JANUARY} and IsRefresh = 0"
MINUTE = ("date_format(EventTime, 'yyyy-MM-dd HH:mm:00')", "strftime(EventTime, '%Y-%m-%d %H:%M:00')")
HOST = (
    r"regexp_replace(Referer, r'^https?://(?:www\.)?([^/]+)/.*$', '$1')",
    r"regexp_replace(Referer, '^https?://(?:www\.)?([^/]+)/.*$', '\1')",
)
SOURCE = "case when SearchEngineID = 0 and AdvEngineID = 0 then Referer else '' end"
WIDTHS = {f"s{i}": total(f"ResolutionWidth + {i}") for i in range(90)}
CLIENT = {"c": ROWS, "refreshes": total("IsRefresh"), "width": mean("ResolutionWidth")}
VIEWS = {"views": ROWS}
ALL_COLUMNS = (
    "WatchID UserID EventTime EventDate CounterID RegionID AdvEngineID SearchEngineID "
    "TraficSourceID ResolutionWidth WindowClientWidth WindowClientHeight MobilePhone "
    "MobilePhoneModel SearchPhrase ClientIP IsRefresh IsLink IsDownload DontCountHits URL Title "
    "Referer URLHash RefererHash"
).split()

REPORTS: dict[str, Report] = {
    "cb0": Report(measures={"c": ROWS}),
    "cb1": Report(measures={"c": ROWS}, where="AdvEngineID <> 0"),
    "cb2": Report(measures={"adv": total("AdvEngineID"), "c": ROWS, "width": mean("ResolutionWidth")}),
    "cb3": Report(measures={"user_avg": mean("UserID")}),
    "cb4": Report(measures={"u": USERS}),
    "cb5": Report(measures={"u": "count(distinct SearchPhrase)"}),
    "cb6": Report(measures={"lo": "min(EventDate)", "hi": "max(EventDate)"}),
    "cb7": top(cols("AdvEngineID"), "AdvEngineID <> 0", limit=0),
    "cb8": top(cols("RegionID"), by="u desc", u=USERS),
    "cb9": top(cols("RegionID"), adv=total("AdvEngineID"), c=ROWS, width=mean("ResolutionWidth"),
               u=USERS),
    "cb10": top(cols("MobilePhoneModel"), "MobilePhoneModel <> ''", "u desc", u=USERS),
    "cb11": top(cols("MobilePhone", "MobilePhoneModel"), "MobilePhoneModel <> ''", "u desc", u=USERS),
    "cb12": top(cols("SearchPhrase"), PHRASE),
    "cb13": top(cols("SearchPhrase"), PHRASE, "u desc", u=USERS),
    "cb14": top(cols("SearchEngineID", "SearchPhrase"), PHRASE),
    "cb15": top(cols("UserID")),
    "cb16": top(cols("UserID", "SearchPhrase")),
    "cb17": Report(cols("UserID", "SearchPhrase"), {"c": ROWS}, limit=10),
    "cb18": top({"UserID": "UserID", "m": "cast(extract(minute from EventTime) as bigint)",
                 "SearchPhrase": "SearchPhrase"}),
    "cb19": Report(cols("UserID"), where="UserID = 7"),
    "cb20": Report(measures={"c": ROWS}, where="URL like '%example%'"),
    "cb21": top(cols("SearchPhrase"), f"URL like '%example%' and {PHRASE}", url="min(URL)", c=ROWS),
    "cb22": top(cols("SearchPhrase"),
                f"Title like '%Google%' and URL not like '%.example.net%' and {PHRASE}",
                url="min(URL)", title="min(Title)", c=ROWS, u=USERS),
    "cb23": Report(cols(*ALL_COLUMNS), where="URL like '%example%'", order=("EventTime", "WatchID"),
                   limit=10),
    "cb24": Report(cols("SearchPhrase"), where=PHRASE, order=("EventTime", "WatchID"), limit=10),
    "cb25": Report(cols("SearchPhrase"), where=PHRASE, order=("SearchPhrase",), limit=10),
    "cb26": Report(cols("SearchPhrase"), where=PHRASE, order=("EventTime", "SearchPhrase"), limit=10),
    "cb27": top(cols("CounterID"), "URL <> ''", "l desc", 25, having="c > 5",
                l=mean("length(URL)"), c=ROWS),
    "cb28": top({"k": HOST}, "Referer <> ''", "l desc", 25, having="c > 5",
                l=mean("length(Referer)"), c=ROWS, referer="min(Referer)"),
    "cb29": Report(measures=WIDTHS),
    "cb30": top(cols("SearchEngineID", "ClientIP"), PHRASE, **CLIENT),
    "cb31": top(cols("WatchID", "ClientIP"), PHRASE, **CLIENT),
    "cb32": top(cols("WatchID", "ClientIP"), **CLIENT),
    "cb33": top(cols("URL")),
    "cb34": top({"one": "1", "URL": "URL"}),
    "cb35": top({"ClientIP": "ClientIP", "ip1": "ClientIP - 1", "ip2": "ClientIP - 2",
                 "ip3": "ClientIP - 3"}),
    "cb36": top(cols("URL"), f"{VISIT} and DontCountHits = 0 and URL <> ''", "views desc", **VIEWS),
    "cb37": top(cols("Title"), f"{VISIT} and DontCountHits = 0 and Title <> ''", "views desc", **VIEWS),
    "cb38": top(cols("URL"), f"{VISIT} and IsLink <> 0 and IsDownload = 0", "views desc", 10, 5, **VIEWS),
    "cb39": top({**cols("TraficSourceID", "SearchEngineID", "AdvEngineID"), "Src": SOURCE,
                 "Dst": "URL"}, VISIT, "views desc", 10, 5, **VIEWS),
    "cb40": top(cols("URLHash", "EventDate"),
                f"{VISIT} and TraficSourceID in (-1, 6) and RefererHash = 13", "views desc", 10, 5,
                **VIEWS),
    "cb41": top(cols("WindowClientWidth", "WindowClientHeight"),
                f"{VISIT} and DontCountHits = 0 and URLHash = 12", "views desc", 10, 5, **VIEWS),
    "cb42": top({"M": MINUTE},
                "CounterID = 62 and EventDate between date '2024-01-14' and date '2024-01-15' "
                "and IsRefresh = 0 and DontCountHits = 0", "M", 10, 5, **VIEWS),
}

for _name, _report in REPORTS.items():
    if _report.limit and not _report.order:
        # any rows may come: checked is how many do, and how many of them the full report has
        full = replace(_report, limit=0)
        n = f"least(count(*), {_report.limit})"
        query(_name, f"select {n} as returned, {n} as in_full from ({full.sql()})")(
            lambda t, r=full, n=_report.limit: limited_in_full(r.frame(t.hits), n)
        )
    else:
        query(_name, _report.sql())(lambda t, r=_report: r.frame(t.hits))
