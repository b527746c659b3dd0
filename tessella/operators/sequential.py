"""The few operators whose rows depend on earlier decisions; each group is one pandas frame."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def diverse_top(df: DataFrame, group: str, order: list[str], ascending: list[bool], tags: str, k: int) -> DataFrame:
    """Rows of each group in order, kept while their tags are disjoint from those of all kept before, at most k."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, used = [], set()
        for at, own in pdf.sort_values(order, ascending=ascending)[tags].items():
            if len(kept) < k and not used & set(own):
                kept.append(at)
                used |= set(own)
        return pdf.loc[kept]

    return df.groupBy(group).applyInPandas(run, df.schema)


def longest_chain(df: DataFrame, group: str, ordinal: str, page: str, least: int = 6) -> DataFrame:
    """(group, length, last_page): the longest run of ordinals 1, 2, 3 ... on strictly rising pages; short ones are left out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        best: dict[int, dict[int, int]] = {}  # ordinal -> page -> length
        top, last = 0, None
        for o, p in sorted(set(zip(pdf[ordinal], pdf[page])), key=lambda x: (x[1], -x[0])):
            n = 1 if o == 1 else max((v for q, v in best.get(o - 1, {}).items() if q < p), default=0) + 1
            if n == o:
                best.setdefault(o, {})[p] = n
                if n > top:
                    top, last = n, p
        out = pd.DataFrame({group: pdf[group].tolist()[:1], "length": [top], "last_page": [last or 0]})
        return out if top >= least else out.iloc[:0]

    return df.groupBy(group).applyInPandas(run, f"{group} {df.schema[group].dataType.simpleString()}, length long, last_page long")


def allocate(df: DataFrame, group: str, key: str, preferred: str) -> DataFrame:
    """Adds seq: the preferred number where it is free, in order of keys, else the lowest free one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        used, out, low = set(), [], 1
        for want in pdf[preferred]:
            if pd.isna(want) or int(want) in used or int(want) < 1:
                while low in used:
                    low += 1
                want = low
            used.add(int(want))
            out.append(int(want))
        return pdf.assign(seq=out)

    return df.groupBy(group).applyInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", seq int")
