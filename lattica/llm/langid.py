"""Language of web pages: text likelihoods, declared language, address and host priors, put together by Bayes' rule."""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Byte trigrams of lower-case text are hashed to so many bins.
BINS = 16_384
#: A text counts as so many trigrams at most: neighbouring trigrams are no independent evidence.
EVIDENCE = 150
#: How often a declaration or an address tells the truth.
DECLARED, ADDRESS = 0.9, 0.8
#: Pages that a prior counts for against those below it.
STRENGTH = 5.0
#: Up to so many languages the model is one dense table and arrays of all are summed by columns; beyond that the table is
#: sparse and sums go by rows. Both are of all languages.
DENSE = 64
#: Soft counts are summed as millionths, so sums do not depend on their order.
UNIT = 1_000_000
#: Languages and the country suffixes where most pages are in them. Suffixes of countries with several (be, ca, ch, in, lu, sg,
#: za and the like) and those sold for any use (ai, io, me, tv and the like) tell none; there a folder may.
_COUNTRIES = {
    "ar": "ae bh eg iq jo kw ly om ps qa sa sd sy ye xn--lgbbat1ad8j xn--mgb9awbf xn--mgbaam7a8h xn--mgbayh7gpa xn--mgbc0a9azcg xn--mgberp4a5d4ar xn--mgbtx2b xn--ogbpf8fl xn--pgbs0dh xn--wgbh1c xn--wgbl6a",
    "az": "az",
    "be": "xn--90ais",
    "bg": "bg xn--90ae",
    "bn": "bd xn--45brj9c xn--54b7fta0cc",
    "bs": "ba",
    "ca": "cat",
    "cs": "cz",
    "da": "dk",
    "de": "at de li",
    "el": "gr xn--qxam",
    "en": "au bb bm bs dm gd gh gi gy ie jm kn ky lr ng nz sl tt uk us zm zw",
    "es": "ar bo cl co cr cu do ec es gt hn mx ni pa pe pr py sv uy ve",
    "et": "ee",
    "eu": "eus",
    "fa": "ir xn--mgba3a4f16a",
    "fi": "fi",
    "fo": "fo",
    "fr": "bf bj bl cd cg ci fr gf gn gp mc mg mq nc ne pf pm sn tf tg wf yt",
    "gl": "gal",
    "gu": "xn--gecrj9c",
    "he": "il xn--4dbrk0ce",
    "hi": "xn--h2brj9c",
    "hr": "hr",
    "hu": "hu",
    "hy": "xn--y9a3aq",
    "id": "id",
    "is": "is",
    "it": "it sm va",
    "ja": "jp",
    "ka": "ge xn--node",
    "kk": "xn--80ao21a",
    "kl": "gl",
    "km": "kh",
    "ko": "kp kr xn--3e0b707e",
    "lt": "lt",
    "lv": "lv",
    "mk": "mk xn--d1alf",
    "mn": "mn xn--l1acc",
    "ms": "bn",
    "my": "mm",
    "ne": "np",
    "nl": "nl sr",
    "no": "no sj",
    "pa": "xn--s9brj9c",
    "pl": "pl",
    "pt": "ao br cv gw mz pt tl",
    "ro": "md ro",
    "ru": "ru su xn--p1ai",
    "sk": "sk",
    "sl": "si",
    "so": "so",
    "sq": "al xk",
    "sr": "rs xn--90a3ac",
    "sv": "ax se",
    "ta": "xn--xkc2dl3a5ee0h",
    "te": "xn--fpcrj9c3d",
    "tg": "tj",
    "th": "th xn--o3cw4h",
    "tr": "tr",
    "uk": "ua xn--j1amh",
    "ur": "xn--mgbai9azgqp6j xn--mgbbh1a71e",
    "uz": "uz",
    "vi": "vn",
    "zh": "cn tw xn--fiqs8s xn--fiqz9s xn--j6w193g xn--kprw13d xn--kpry57d",
}
SUFFIXES = {suffix: lang for lang, suffixes in _COUNTRIES.items() for suffix in suffixes.split()}
#: Second levels under which hosts are registered.
_SECOND = frozenset(("ac", "co", "com", "edu", "gov", "net", "org"))

_DROP = re.compile(r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
_DECLARED = re.compile(r"""(?is)<html\b[^>]*?\b(?:xml:)?lang\s*=\s*["']?\s*([a-z]{2,3})\b""")
_META = re.compile(r"""(?is)<meta\b[^>]*?content-language[^>]*?content\s*=\s*["']?\s*([a-z]{2,3})\b""")
_HOST = re.compile(r"(?i)^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::\d*)?(?:/([^/?#]*))?")


def page_text(html: str | None) -> str:
    return " ".join(entities.unescape(_DROP.sub(" ", html or "")).split())


def declared(html: str | None) -> str | None:
    found = _DECLARED.search(html or "") or _META.search(html or "")
    return found[1].lower() if found else None


def address(url: str | None) -> tuple[str, str, str | None]:
    """(host, domain, language of its suffix or of a first folder that is a language code)"""
    found = _HOST.match(url or "")
    if not found:
        return "", "", None
    host = found[1].lower().rstrip(".")
    labels = host.split(".")
    n = 3 if len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in _SECOND else 2
    suffix = SUFFIXES.get(labels[-1]) or (found[2].lower()[:2] if found[2] and re.fullmatch(r"(?i)[a-z]{2}([-_][a-z]{2})?", found[2]) else None)
    return host, ".".join(labels[-n:]), suffix


def trigrams(text: str | None, bins: int = BINS) -> np.ndarray:
    """Bins of the byte trigrams of the lower-case text, of letters and single spaces only."""
    data = np.frombuffer(re.sub(r"[\W\d_]+", " ", f" {text or ''} ".lower()).encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, dtype=np.int64)
    return ((data[:-2] * 0x9E3779B1 + data[1:-1] * 0x85EBCA6B + data[2:] * 0xC2B2AE35) >> 8).astype(np.int64) % bins


class TextModel:
    """Log shares of trigram bins by language, from counts: arrays lang, bin and n of those that are not 0."""

    def __init__(self, langs: list[str], lang: np.ndarray, cell: np.ndarray, n: np.ndarray, bins: int = BINS):
        self.langs, self.bins = langs, bins
        totals = np.bincount(lang, weights=n, minlength=len(langs)) + 0.5 * bins
        self.unseen = np.log(0.5 / totals)
        self.dense = len(langs) <= DENSE
        if self.dense:
            smooth = np.full((len(langs), bins), 0.5)
            smooth[lang, cell] += n
            self.log = np.log(smooth / totals[:, None])
            return
        # by bin: the languages that have it, and how much more than an unseen bin it says for them
        order = np.argsort(cell, kind="stable")
        self.lang = lang[order].astype(np.int32)
        self.more = np.log1p(n[order] / 0.5)
        self.start = np.searchsorted(cell[order], np.arange(bins + 1))

    def evidence(self, text: str | None) -> np.ndarray:
        """Log likelihood of the text in each language, as of at most EVIDENCE trigrams."""
        found = trigrams(text, self.bins)
        if not len(found):
            return np.zeros(len(self.langs))
        if self.dense:
            return self.log[:, found].mean(axis=1) * min(len(found), EVIDENCE)
        cells, times = np.unique(found, return_counts=True)
        sizes = self.start[cells + 1] - self.start[cells]
        at = np.arange(sizes.sum()) + np.repeat(self.start[cells] - np.cumsum(sizes) + sizes, sizes)
        more = np.bincount(self.lang[at], weights=self.more[at] * np.repeat(times, sizes), minlength=len(self.langs))
        return (self.unseen + more / len(found)) * min(len(found), EVIDENCE)


def text_model(docs: DataFrame, bins: int = BINS) -> TextModel:
    """Trigram counts of all texts of docs (text, lang), by every language; the model, not the corpus, comes to the driver."""
    known = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def run(batches):
        held: dict = {}

        def part():
            for lang, counts in held.items():
                cell = np.nonzero(counts)[0]
                # a text without trigrams makes its language known as well
                cell = cell if len(cell) else np.zeros(1, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cell), pa.string()), pa.array(cell.astype(np.int32)), pa.array(counts[cell])], ["lang", "bin", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if lang not in held:
                    if len(held) >= DENSE:
                        yield from part()
                    held[lang] = np.zeros(bins, dtype=np.int64)
                held[lang] += np.bincount(trigrams(text.as_py(), bins), minlength=bins)
        yield from part()

    got = known.mapInArrow(run, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    coded = got["lang"].combine_chunks().dictionary_encode() if got.num_rows else pa.array([], pa.string()).dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    names = coded.dictionary.to_pylist()
    langs = sorted(names)
    place = {lang: k for k, lang in enumerate(langs)}
    number = np.array([place[x] for x in names], dtype=np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if names else np.zeros(0, dtype=np.int64)
    return TextModel(langs, number, got["bin"].to_numpy().astype(np.int64), got["n"].to_numpy(), bins)


def _shares(log: np.ndarray) -> np.ndarray:
    p = np.exp(log - log.max())
    return p / p.sum()


def _told(langs: list[str], said: str | None, truth: float) -> np.ndarray:
    """Log likelihood of what was said; nothing said, or an unknown language, is no evidence."""
    if said not in langs or len(langs) < 2:
        return np.zeros(len(langs))
    out = np.full(len(langs), np.log((1 - truth) / (len(langs) - 1)))
    out[langs.index(said)] = np.log(truth)
    return out


def identified(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, host, lang, posterior (rounded to 6 places), declared, address_lang,
    text_lang (likeliest by text alone; null without letters), host_prior (of lang), n_trigrams.

    The posterior of a language is its prior on the host times the likelihoods of the text, the declaration and the
    address. The priors come from all other pages: their posteriors without a prior are summed by host, by domain and in
    all; a host's shares are smoothed with its domain's, those with all pages', those with equal ones, and the page's
    own part is taken out. Null urls and those without a host are of one host ''; a null html is empty. Without
    documents of a known language there is no language: lang is null. Repeated rows are pages of their own; an empty table gives none.
    """
    model = text_model(docs)
    langs, k = model.langs, len(model.langs)
    fields = "page_id long, host string, domain string, declared string, address_lang string, text_lang string, n_trigrams long, evidence array<double>, own array<long>"

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for page, url, html in zip(*(c.to_pylist() for c in part.columns)):
                    host, domain, suffix = address(url)
                    said, text = declared(html), page_text(html)
                    n = len(trigrams(text)) if text else 0
                    by_text = model.evidence(text) if text else np.zeros(k)
                    log = by_text + _told(langs, said, DECLARED) + _told(langs, suffix, ADDRESS)
                    own = np.rint(_shares(log) * UNIT).astype(np.int64) if k else np.zeros(0, dtype=np.int64)
                    rows.append({"page_id": page, "host": host, "domain": domain, "declared": said, "address_lang": suffix, "text_lang": langs[int(by_text.argmax())] if n and k else None, "n_trigrams": n, "evidence": log.tolist(), "own": own.tolist()})
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    told = cut(source.mapInArrow(run, fields))
    if not k:
        nothing = F.lit(None)
        return told.select("page_id", "host", nothing.cast("string").alias("lang"), nothing.cast("double").alias("posterior"), "declared", "address_lang", "text_lang", nothing.cast("double").alias("host_prior"), "n_trigrams")

    def summed(df, *by):
        if k > DENSE:
            each = df.select(*by, F.posexplode("own").alias("at", "n")).groupBy(*by, "at").agg(F.sum("n").alias("n"))
            return each.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias("own"))
        return df.groupBy(*by).agg(F.array(*(F.sum(F.col("own")[i]) for i in range(k))).alias("own"))

    hosts = summed(told, "host", "domain")
    domains = cut(summed(hosts, "domain"))
    every = [x or 0 for x in summed(domains).first()[0]]
    levels = hosts.join(domains.withColumnRenamed("own", "in_domain"), "domain").select("host", F.col("own").alias("in_host"), "in_domain")
    rows = told.join(levels, "host")

    def smoothed(counts, below):
        """Shares of the counts without the page's own, with STRENGTH pages spread like `below`."""
        rest = F.zip_with(counts, "own", lambda a, b: (a - b) / UNIT)
        total = F.aggregate(rest, F.lit(0.0), lambda s, x: s + x)
        return F.transform(F.arrays_zip(rest.alias("a"), below.alias("b")), lambda x: (x["a"] + STRENGTH * x["b"]) / (total + STRENGTH))

    rows = rows.withColumn("p_all", smoothed(F.array(*(F.lit(int(x)) for x in every)), F.array(*(F.lit(1.0 / k) for _ in range(k)))))
    rows = rows.withColumn("p_domain", smoothed(F.col("in_domain"), F.col("p_all")))
    rows = rows.withColumn("prior", smoothed(F.col("in_host"), F.col("p_domain")))
    rows = rows.withColumn("log", F.zip_with("evidence", "prior", lambda e, p: e + F.log(p)))
    rows = rows.withColumn("top", F.array_max("log"))
    rows = rows.withColumn("weight", F.transform("log", lambda x: F.exp(x - F.col("top"))))
    best = F.array_position("log", F.col("top")).cast("int")
    total = F.aggregate("weight", F.lit(0.0), lambda s, x: s + x)
    return rows.select(
        "page_id",
        "host",
        F.element_at(F.array(*(F.lit(x) for x in langs)), best).alias("lang"),
        F.round(1 / total, 6).alias("posterior"),
        "declared",
        "address_lang",
        "text_lang",
        F.round(F.element_at("prior", best), 6).alias("host_prior"),
        "n_trigrams",
    )


_SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("host", pa.string()), ("domain", pa.string()), ("declared", pa.string()), ("address_lang", pa.string()), ("text_lang", pa.string()), ("n_trigrams", pa.int64()), ("evidence", pa.list_(pa.float64())), ("own", pa.list_(pa.int64()))]
)
