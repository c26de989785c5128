"""Licence scan by canonical digest: whole texts, brought to one spelling, are looked up by SHA-256.

Canonical form: lower case; copyright notices cut, each up to the end of its line or sentence, or to where a licence begins;
equivalent spellings made one; every run of anything but a-z and 0-9 one space. A text of nothing but notices keeps
them. The digests of known licences are a small fixed table; a caller's own table is joined by hash like it, and only
broadcast where its bytes are known to be few.

Null and empty texts have the digest of the empty text, which is no licence. Rows are independent: repeated rows and
ids are rows of their own. Known digests that repeat count once, under their smallest name. An empty table gives an
empty result. Very long texts are canonicalised whole, in time linear in the text. Other columns are ignored.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns are those that Java and RE2 read alike; all texts are in lower case by then.
_YEAR = "(?:19|20)[0-9]{2}"
_SIGN = rf"(?:copyrights?[ \t]*(?:\(c\)|©|:|by[ \t]|{_YEAR})|(?:\(c\)|©)[ \t]*(?:copyright|by[ \t]|{_YEAR}))"
#: What ends a notice that does not end with its line: a sentence (no initial ends one), or the first words of a licence.
_END = r"\n|\z|all rights reserved|permission (?:is|to)[ \t]|redistributions? |licensed under|this (?:software|program|file|work|is)[ \t]|everyone is permitted"
NOTICES = (
    rf"{_SIGN}[^\n]{{0,300}}?(?:[a-z0-9]{{3}}[.;][ \t]|({_END}))",
    rf"(?m)^[^a-z0-9\n]*(?:copyright |©)[^\n]{{0,120}}?{_YEAR}[^a-z\n]*($)",
    r"all rights reserved[.]?",
)
#: What each leaves; {} is its group.
_LEFT = (" {}", " {}", " ")
#: Spellings that licence matching treats as equal, in canonical letters: pattern, spelling; {} is the first group.
SPELLINGS = (
    ("sub licen[cs]e", "sublicense"), ("licen[cs]e", "license"), ("non commercial", "noncommercial"), ("copyright owner", "copyright holder"), ("acknowledgement", "acknowledgment"),
    ("(author|capital|categor|emphas|initial|maxim|optim|organ|real|recogn|util)is(?:e|ing|ation)", "{}iz"), ("(author|capital|categor|emphas|initial|maxim|optim|organ|real|recogn|util)iz(?:e|ing|ation)", "{}iz"),
    ("(fav|hon|lab)our", "{}or"), ("(anal|catal)ogue", "{}og"), ("analyse", "analyze"), ("artefact", "artifact"), ("calibre", "caliber"), ("centre", "center"), ("(cancel|label|model|signal)l(ed|ing)", "{}{2}"), ("defence", "defense"), ("offence", "offense"),
    ("judgement", "judgment"), ("practise", "practice"), ("programme", "program"), ("https", "http"), ("per cent", "percent"), ("whilst", "while"), ("fulfil", "fulfill"), ("fulfilll", "fulfill"), ("wilful", "willful"),
)


def _literals(pattern: str) -> list[str]:
    """Texts of which any match of the pattern begins with one: its first alternatives, up to the next bracket."""
    heads, rest = ([pattern], "") if pattern[0] != "(" else (pattern[1 : pattern.index(")")].split("|"), pattern[pattern.index(")") + 1 :])
    return [(head + rest).split("(")[0].split("[")[0] for head in heads]


#: What a text with a notice, or with another spelling, holds; most texts hold neither and are spared a pass for each pattern.
HAS_NOTICE = r"copyright|\(c\)|©|all rights reserved"
HAS_SPELLING = tuple(x for pattern, _ in SPELLINGS for x in _literals(pattern))
#: SHA-256 of the canonical forms of the published wordings; ``tests/llm/wordings.py`` has them or names the file.
KNOWN: dict[str, str] = {
    "MIT": "35a446201226de6b27cfb7106d0f6c697f63bfeac2913dcf89024911e66ef164",
    "ISC": "f172f90a892d869d5d840d5f4363218a9b21bdb1bd3925ba9c752d1660134fee",
    "0BSD": "9c842909bcc85365ba7f0d106fccdc3af51784431076174588a9832837ebf153",
    "BSD-2-Clause": "447686a56472ea2e9713ca89034ee666e6646bd1a33eba38690cb875708663e2",
    "BSD-3-Clause": "cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15",
    "Zlib": "99618428d879198d4ae824db7ad07a9d0f9214f15429de52839cbe667713f21a",
    "Unlicense": "c4ac40b2a0a75b5ac0f846ac37ef2bc398946d47549339e1099548a8fd29a540",
    "Apache-2.0 (notice)": "7a46cf4a5d56898d746584f4fe57bdf571d600a8f39d21063431d88929f803c7",
    "GPL-3.0 (notice)": "b1165b3a9c3ac2638585a8adb6e0c10814b7d97627160747134355b2690ff5af",
    "Apache-2.0 (line)": "28de6b6f31af692f3276f4c7d7f809bc7d39d3206a71fe090d61d943447aabc6",
    "MIT (line)": "123a3b9fdc300d1b6f077f74b288de15d7f2c5b0b3b11e89fd799b48bfad5940",
    "GPL-3.0 (line)": "37d45dc3b9135ed58bd277e14112dfea95629cda77a8d62cdb6bcd862e7b5bf5",
    "CC-BY-NC-4.0 (line)": "e34399ae0e957e9bb9b4a0e3f615d05722861801f4e0718f35cefc762c349a16",
    "MIT (body)": "0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c",
    "ISC (body)": "217da0747cec63a2e734185db11cbaa819bcd9e5b83cd12f812128fffe66e26a",
    "0BSD (body)": "25a274d52b3014d9bd64e0f3362fd279ac1655f163d5c518f6b9f6c43354802c",
    "BSD-2-Clause (body)": "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30",
    "BSD-3-Clause (body)": "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2",
    "Zlib (body)": "1b8c5cd52eceb19ab0bc3cb40be110b1c0e7fa2671a3fe5866e59dd1502e69c7",
    "Apache-2.0": "c162d3b780c53aea16b7603126f8117e4cc8faf284e7bcf3c65cd535544431a4",
    "Artistic-1.0-Perl": "9ec53d4d69a985757ac0e40cc7edf636c180e73b48f440ecede9967ea8db1705",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "1884457c1d9cf905afa45854fceb2cc6d7d3e9cfdca596ab06d4e8a952aebe7a",
    "GFDL-1.3": "2474fbda3d3addbdd0956f3e3aa6fd631a9f0436b27a154705699c3d1567166f",
    "GPL-1.0": "cbdccc39d3921ad822df3db3f1e1e240d95e9475f5314b13409b57abde669960",
    "GPL-2.0": "9446e90729c87bfcb99cac9c416311543826b8e4fcb49ab618db8533715c22e2",
    "GPL-3.0": "b7baa9fa8c158fca1ae614790f4dbb2fa8622ea2c034ba9ebb1bb784f87b69cc",
    "LGPL-2.0": "6a1498a259a37b0b5821d206ba11b0a685703469e5f4f0fe8336c2a9dfa614ab",
    "LGPL-2.1": "97f34dfa273c52b1fc44070cfed8fb000db712a5fe0f680def6d297f6285d67c",
    "LGPL-3.0": "95ea22b82d01fe81be4af38fd3796321a1598322e58f5db0bed0dc7ee49b0ab8",
    "MPL-1.1": "92c914d0f8d05f58639c2f26ab3fc4b324ae5e22faa5c69ff93b03bd08674ca3",
    "MPL-2.0": "a4f050f4bb60d52520f2bb719fcd3e89062ead5d437f9c85aeaa5b578c082a03",
    "Apache-2.0 (terms)": "40a5cbdde648407ecda9cd299e289d79745972b29e4d1a40804bc593872fdc44",
}
#: Bytes of a table of known digests that may be broadcast.
SMALL = 16 << 20


def _java(spelling: str) -> str:
    return spelling.replace("{}", "$1").replace("{2}", "$2")


def _re2(spelling: str) -> str:
    return spelling.replace("{}", "\\1").replace("{2}", "\\2")


def _plain(low: Column) -> Column:
    low = other = F.regexp_replace(low, "[^a-z0-9]+", " ")
    for pattern, spelling in SPELLINGS:
        other = F.regexp_replace(other, pattern, _java(spelling))
    return F.trim(F.when(functools.reduce(operator.or_, [low.contains(x) for x in HAS_SPELLING]), other).otherwise(low))


def canonical(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    cut = low
    for pattern, left in zip(NOTICES, _LEFT):
        cut = F.regexp_replace(cut, pattern, _java(left))
    # A text of nothing but notices keeps them.
    return _plain(F.when(low.rlike(HAS_NOTICE), F.when(cut.rlike("[a-z0-9]"), cut).otherwise(low)).otherwise(low))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_licences(spark) -> DataFrame:
    return spark.createDataFrame([(v, k) for k, v in KNOWN.items()], "digest string, licence string")


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, licence (null where the whole text is no known licence)."""
    table = known_licences(docs.sparkSession) if known is None else known
    table = table.groupBy("digest").agg(F.min("licence").alias("licence"))
    if known is None or (table.agg(F.sum(F.octet_length("digest") + F.octet_length("licence") + 32).alias("b")).first()["b"] or 0) <= SMALL:
        table = F.broadcast(table)
    return docs.select(F.col("doc_id").cast("long"), digest(F.col("text")).alias("digest")).join(table, "digest", "left").select("doc_id", "digest", "licence")


def oracle(table: str = "documents") -> str:
    def plain(expr: str) -> str:
        expr = f"regexp_replace({expr}, '[^a-z0-9]+', ' ', 'g')"
        for pattern, spelling in SPELLINGS:
            expr = f"regexp_replace({expr}, '{pattern}', '{_re2(spelling)}', 'g')"
        return f"trim({expr})"

    cut = "low"
    for pattern, left in zip(NOTICES, _LEFT):
        cut = f"regexp_replace({cut}, '{pattern}', '{_re2(left)}', 'g')"
    names = ", ".join(f"('{v}', '{k}')" for k, v in KNOWN.items())
    return f"WITH l AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM {table}), c AS (SELECT *, {cut} AS cut FROM l), d AS (SELECT doc_id, sha256({plain("CASE WHEN regexp_matches(cut, '[a-z0-9]') THEN cut ELSE low END")}) AS digest FROM c), k(digest, licence) AS (VALUES {names}) SELECT doc_id, d.digest AS digest, licence FROM d LEFT JOIN k ON d.digest = k.digest"
