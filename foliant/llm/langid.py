"""Problem 6: the language of each record and of each passage in another language, with a confidence.

Method: Bayesian evidence fusion. Each sentence has a log-likelihood under every language (word models, fitted on a
bounded sample of labelled rows and refined by re-assigning its sentences; common words of each language are the
start). To the record's sentences are added, as log-odds, the evidence of

* the declared label, by how often that language is declared right and wrong,
* the address suffix, if a column with an address is given,
* the host: shares of declared languages by host, smoothed towards the host's family, towards all records, computed
  by grouped aggregation over all records.

Long sentences decide by themselves; the other evidence decides short or mixed ones. A language other than the main one
is reported only for whole sentences (begun with a capital, ended with a stop); the main language also for a text
without one.

Texts never leave the scan: Python returns a few numbers per sentence, and only those meet the host priors. Null or
empty text, or text without a known word, gives no row. Repeated records each give their rows. Output of ``identify``:
the id columns, ``label`` (normalised declared language, null if missing), ``lang string, sentences int, whole int,
confidence double``, one row per record and language. ``segments`` gives each passage of a record a row of its own. The host
prior of a record leaves its own label out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm._arrow import id_schema, map_batches
from foliant.llm.sample import bounded_sample
from foliant.llm.words import NO, Corpus, Memo, flags

LANGS = ("en", "es", "de", "fr", "pt")
MAX_LABELLED, ROUNDS, MIN_KNOWN, MIN_ROWS, SMOOTH = 4000, 3, 3, 3, 0.2
P_RIGHT, HOST_WEIGHT, FAMILY_WEIGHT, CAP, SALTS = 0.85, 4.0, 20.0, 6.0, 16
SUFFIXES = {"uk": "en", "us": "en", "au": "en", "ie": "en", "es": "es", "mx": "es", "ar": "es", "cl": "es", "de": "de", "at": "de", "fr": "fr", "pt": "pt", "br": "pt"}
# How a language is declared, besides its code with a region.
NAMES = {
    "en": "en eng english englisch anglais inglés ingles inglês",
    "es": "es spa esp spanish español espanol castellano castilian spanisch espagnol",
    "de": "de deu ger german deutsch alemán aleman allemand alemão",
    "fr": "fr fra fre french français francais französisch francés francês",
    "pt": "pt por portuguese português portugues portugués portugiesisch portugais",
}
UNKNOWN = "und n/a na unknown none null nan mul mis zxx xx ? - -- other unbekannt desconocido inconnu desconhecido"
# Common words that few of the other languages share.
SEEDS = {
    "en": "the of and to in is was were with for by that from this these which an be been at on as it not has had how between after",
    "es": "el los las del y que con por para fue era según cuando también más aunque muestra como una son esta nuestro grupo sigue siendo además",
    "de": "der die das und den dem ein eine ist war nicht mit für von auch wie wir wird wurde haben bei nach obwohl wenn zeigt außerdem",
    "fr": "le les des du et une est été dans avec plus au cette lorsque selon entre bien soit comme montre notre ce que qui reste devient",
    "pt": "o os da do das dos não foi com mais ao pela pelo quando embora segundo como mostra nosso também fosse ainda é à em uma isso",
}


def declared(label: Column) -> Column:
    """The language a label declares: its code, '??' for a language not in use, null for none."""
    low = F.lower(F.trim(label))
    main = F.regexp_extract(low, r"^(\p{L}+)", 1)
    known = F.create_map(*[F.lit(x) for k, v in NAMES.items() for n in v.split() for x in (n, k)])
    return F.when(low.isNull() | (low == "") | low.isin(UNKNOWN.split()), F.lit(None).cast("string")).otherwise(F.coalesce(known[main], F.lit("??")))


class Words:
    """A log-likelihood per word and language; words outside the vocabulary say nothing."""

    def __init__(self, vocab: dict[str, int], table: np.ndarray):
        self.vocab, self.table = vocab, table

    def memo(self) -> Memo:
        vocab = self.vocab
        return Memo(lambda x: (vocab.get((f := flags(x))[0], NO) << 2) | f[1])

    def score(self, c: Corpus) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods and known words of each sentence."""
        if not len(c.word):
            return np.zeros((0, len(LANGS))), np.zeros(0, dtype=np.int64)
        return np.add.reduceat(self.table[c.word], c.first, axis=0), np.add.reduceat((c.word != NO).astype(np.int64), c.first)


def seed_words(extra: set[str] = frozenset()) -> Words:
    """The start: common words only."""
    vocab = {w: k + 1 for k, w in enumerate(sorted({w for v in SEEDS.values() for w in v.split()} | extra))}
    table = np.zeros((len(vocab) + 1, len(LANGS)))
    for k, lang in enumerate(LANGS):
        for w in SEEDS[lang].split():
            table[vocab[w], k] += 2.0
    return Words(vocab, table)


def fit_words(texts: list[str], labels: list[str | None]) -> Words:
    seen: dict[str, int] = {}
    word = Memo(lambda x: flags(x)[0])
    for t in texts:
        for w in {word[x] for x in t.split()}:
            seen[w] = seen.get(w, 0) + 1
    model = seed_words({w for w, n in seen.items() if w and n >= MIN_ROWS})
    c = Corpus(texts, model.memo())
    if not len(c.word):
        return model
    prior = np.zeros((len(texts), len(LANGS)))
    for i, x in enumerate(labels):
        if x in LANGS:
            prior[i, LANGS.index(x)] = 1.0
    n, v = len(LANGS), len(model.vocab) + 1
    for _ in range(ROUNDS):
        g, known = model.score(c)
        best = (g + prior[c.text]).argmax(axis=1)
        own = np.where(known >= MIN_KNOWN, best, -1)[c.sentence]
        ok = own >= 0
        counts = np.bincount(c.word[ok] * n + own[ok], minlength=v * n).reshape(v, n) + SMOOTH
        share = counts / counts.sum(axis=0)
        # a word's say is its likelihood against the mean over the languages, within bounds: names say little
        table = np.clip(np.log(share) - np.log(share.mean(axis=1, keepdims=True)), -4, 2)
        table[NO] = 0
        few = counts.sum(axis=1) < MIN_ROWS + n * SMOOTH
        table[few] = model.table[few]
        model = Words(model.vocab, table)
    return model


def train(df: DataFrame, id_col: str, text: str, label: str, most: int = MAX_LABELLED) -> Words:
    """At most ``most`` labelled rows, those of the smallest hashes of the id."""
    rows = df.where(F.col(text).isNotNull() & declared(F.col(label)).isin(*LANGS)).select(F.col(id_col).alias("k"), declared(F.col(label)).alias("l"), F.col(text).alias("t"))
    pairs = [(r.t, r.l) for r in bounded_sample(rows, "k", most).toLocalIterator()]
    return fit_words([t for t, _ in pairs], [x for _, x in pairs])


def sentence_scores(df: DataFrame, ids: list[str], text: str, model: Words, places: bool = False) -> DataFrame:
    """The id columns and, per row, the arrays ``whole boolean`` and ``score`` (the languages' log-likelihoods, flat) of its sentences.
    ``places``: and ``place`` (their first and last words in the text, from 1, flat)."""
    n, m = len(ids), len(LANGS)

    def make():
        memo = model.memo()

        def work(b: pa.RecordBatch) -> dict:
            texts = b.column(n).to_pylist()
            parts = []
            for a in range(0, len(texts), 1000):
                part = texts[a : a + 1000]
                c = Corpus(part, memo)
                g, known = model.score(c)
                keep = np.flatnonzero(known >= MIN_KNOWN)
                if not len(keep):
                    keep = np.flatnonzero(known > 0)
                else:  # texts without such a sentence keep what they have
                    lone = np.setdiff1d(c.text[known > 0], c.text[keep])
                    keep = np.union1d(keep, np.flatnonzero((known > 0) & np.isin(c.text, lone)))
                begins = np.searchsorted(c.text, np.arange(len(part)))  # each text's first sentence
                first = c.first[keep] - c.first[begins[c.text[keep]]] + 1 if len(keep) else keep
                place = np.stack([first, first + c.size[keep] - 1], axis=1) if len(keep) else np.zeros((0, 2), dtype=np.int64)
                parts.append((c.text[keep] + a, g[keep], c.whole[keep] & (known[keep] >= MIN_KNOWN), place))
            row = np.concatenate([x[0] for x in parts])
            g, whole = np.concatenate([x[1] for x in parts]), np.concatenate([x[2] for x in parts])
            rows, first = np.unique(row, return_index=True)
            ends = np.append(first, len(row)).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(ends * m, pa.int32()), pa.array(g.astype(np.float32).ravel(), pa.float32()))
            take = pa.array(rows, pa.int64())
            spots = np.concatenate([x[3] for x in parts]).ravel()
            extra = {"place": pa.ListArray.from_arrays(pa.array(ends * 2, pa.int32()), pa.array(spots, pa.int32()))} if places else {}
            return extra | {c: b.column(k).take(take) for k, c in enumerate(ids)} | {
                "whole": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(whole)),
                "score": flat,
            }

        return work

    return map_batches(df.select(*ids, F.col(text).alias("__t")), make, f"{id_schema(df, ids)}, whole array<boolean>, score array<float>" + (", place array<int>" if places else ""))


def host_priors(df: DataFrame, host: str, family: str, label: str) -> DataFrame:
    """``host, prior array<double>``: per host the counts of its declared languages, then what its family adds to them (smoothed
    in two steps). A record leaves its own label out of the counts before they are taken for a prior."""
    lang = declared(F.col(label))
    base = df.where(F.col(host).isNotNull()).select(F.col(host).alias("host"), F.coalesce(F.col(family), F.lit("")).alias("family"), lang.alias("l"))
    by_host = base.groupBy("host", "family").agg(*[F.count_if(F.col("l") == x).alias(x) for x in LANGS])
    by_family = by_host.groupBy("family").agg(*[F.sum(x).alias(f"f_{x}") for x in LANGS])
    total = base.agg(*[F.count_if(F.col("l") == x).alias(x) for x in LANGS]).first()  # five numbers
    all_n = sum(total[x] for x in LANGS)
    fam_n = sum((F.col(f"f_{x}") for x in LANGS), F.lit(0))
    host_n = sum((F.col(x) for x in LANGS), F.lit(0))
    p0 = {x: (total[x] + 1) / (all_n + len(LANGS)) for x in LANGS}
    p1 = {x: (F.col(f"f_{x}") + FAMILY_WEIGHT * p0[x]) / (fam_n + FAMILY_WEIGHT) for x in LANGS}
    p2 = [*(F.col(x).cast("double") for x in LANGS), *(HOST_WEIGHT * F.col(f"p_{x}") for x in LANGS)]
    families = by_family.select("family", *[p1[x].alias(f"p_{x}") for x in LANGS])
    # one row per host, also where a host has several families
    per = by_host.join(families, "family").select("host", F.array(*p2).alias("prior"), host_n.alias("n"))
    return per.groupBy("host").agg(F.max_by("prior", F.struct("n", "prior")).alias("prior"))


def scored(df: DataFrame, ids: list[str], text: str, label: str, host: str, family: str | None, address: str | None, model: Words | None, places: bool) -> DataFrame:
    """Sentences' likelihoods with the record's label, address suffix and host prior."""
    fam = F.col(family) if family else F.lit("")
    suffix = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])[F.regexp_extract(F.lower(F.col(address)), r"^(?:https?://)?[^/:?#]*\.([a-z]{2,})(?:[/:?#]|$)", 1)] if address else F.lit(None).cast("string")
    base = df.withColumns({"__host": F.col(host).cast("string"), "__fam": fam.cast("string"), "__label": declared(F.col(label)), "__suffix": suffix})
    model = model or train(df, ids[-1], text, label)
    scores = sentence_scores(base, [*ids, "__label", "__suffix", "__host"], text, model, places)
    priors = host_priors(base, "__host", "__fam", label)
    # one host may hold a third of all rows: its records go over SALTS tasks, its one prior row to each of them
    salted = scores.withColumn("__salt", F.pmod(F.xxhash64(*ids), F.lit(SALTS)).cast("int"))
    priors = priors.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(priors, (salted["__host"] == priors["host"]) & (salted["__salt"] == priors["salt"]), "left")


def identify(df: DataFrame, ids: list[str], text: str, label: str, host: str, family: str | None = None, address: str | None = None, model: Words | None = None) -> DataFrame:
    per = fuse(scored(df, ids, text, label, host, family, address, model, False), ids)
    return per.groupBy(*ids, "label", "lang").agg(
        F.sum("sentences").cast("int").alias("sentences"), F.sum("whole").cast("int").alias("whole"), F.round(F.sum("p") / F.sum("sentences"), 4).alias("confidence")
    )


def segments(df: DataFrame, ids: list[str], text: str, label: str, host: str, family: str | None = None, address: str | None = None, model: Words | None = None) -> DataFrame:
    """The passages of each record: the id columns, ``segment int`` (from 1), ``lang``, ``first_word, last_word`` (of the text's words, from 1),
    ``sentences int, confidence double``. Consecutive sentences of one language are one passage; sentences without a known word are in none."""
    return fuse(scored(df, ids, text, label, host, family, address, model, True), ids, True)


def evidence(labels: list[str | None], weight: float) -> np.ndarray:
    """Log-odds that a declared language adds: right with P_RIGHT, else any other."""
    say = weight * np.log(P_RIGHT / ((1 - P_RIGHT) / (len(LANGS) - 1)))
    out = np.zeros((len(labels), len(LANGS)))
    for i, x in enumerate(labels):
        if x in LANGS:
            out[i, LANGS.index(x)] = say
    return out


def fuse(joined: DataFrame, ids: list[str], passages: bool = False) -> DataFrame:
    """Posterior of each sentence from its likelihoods, the label, the suffix and the host prior; a row per record and language, or per passage."""
    n, m = len(ids), len(LANGS)

    def make():
        def posterior(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
            """Each sentence's record, best language, its probability, and whether it is whole."""
            label, suffix = b.column(n).to_pylist(), b.column(n + 1).to_pylist()
            prior = np.array([[0.0] * m + [1.0] * m if x is None else x for x in b.column(n + 2).to_pylist()], dtype=np.float64).reshape(-1, 2 * m)
            own = np.array([[x == y for y in LANGS] for x in label], dtype=np.float64).reshape(-1, m)
            prior = np.log(np.maximum(prior[:, :m] - own, 0) + prior[:, m:])
            whole = b.column(n + 3)
            sizes = np.diff(np.asarray(whole.offsets)) if len(whole) else np.zeros(0, dtype=np.int64)
            row = np.repeat(np.arange(b.num_rows), sizes)
            w = np.asarray(whole.flatten().to_numpy(zero_copy_only=False), dtype=bool)
            g = np.asarray(b.column(n + 4).flatten(), dtype=np.float64).reshape(-1, m)
            extra = evidence(label, 1.0) + evidence(suffix, 0.5) + prior
            extra = np.maximum(extra - extra.max(axis=1, keepdims=True), -CAP)
            g = g + extra[row]
            return row, g.argmax(axis=1), 1 / np.exp(g - g.max(axis=1, keepdims=True)).sum(axis=1), w

        def work(b: pa.RecordBatch) -> dict:
            row, best, p, w = posterior(b)
            if passages:
                place = np.asarray(b.column(n + 5).flatten()).reshape(-1, 2)
                new = np.ones(len(row), dtype=bool)
                new[1:] = (row[1:] != row[:-1]) | (best[1:] != best[:-1])
                first = np.flatnonzero(new)
                many = np.diff(np.append(first, len(row)))
                owner = row[first]
                number = np.arange(len(first)) - np.searchsorted(owner, owner) + 1
                take = pa.array(owner, pa.int64())
                return {c: b.column(k).take(take) for k, c in enumerate(ids)} | {
                    "segment": pa.array(number, pa.int32()),
                    "lang": pa.array([LANGS[x] for x in best[first]], pa.string()),
                    "first_word": pa.array(place[first, 0], pa.int32()),
                    "last_word": pa.array(place[first + many - 1, 1], pa.int32()),
                    "sentences": pa.array(many, pa.int32()),
                    "confidence": pa.array(np.round(np.add.reduceat(p, first) / many, 4) if len(first) else p, pa.float64()),
                }
            key, at = np.unique(row * m + best, return_inverse=True)
            take = pa.array(key // m, pa.int64())
            got = {c: b.column(k).take(take) for k, c in enumerate(ids)} | {"label": b.column(n).take(take)}
            return got | {
                "lang": pa.array([LANGS[x] for x in key % m], pa.string()),
                "sentences": pa.array(np.bincount(at, minlength=len(key)), pa.int64()),
                "whole": pa.array(np.bincount(at, weights=w, minlength=len(key)).astype(np.int64), pa.int64()),
                "p": pa.array(np.bincount(at, weights=p, minlength=len(key)), pa.float64()),
            }

        return work

    cols = joined.select(*ids, "__label", "__suffix", "prior", "whole", "score", *(["place"] if passages else []))
    rows = "segment int, lang string, first_word int, last_word int, sentences int, confidence double" if passages else "label string, lang string, sentences bigint, whole bigint, p double"
    return map_batches(cols, make, f"{id_schema(joined, ids)}, {rows}")


def cases(found: DataFrame, ids: list[str]) -> DataFrame:
    """Records whose label is missing, names a language not in the text, or whose text has several languages: a row per language."""
    everyone = F.struct(F.col("whole") > 0, F.col("sentences"), F.col("lang"))
    per = found.groupBy(*ids).agg(
        F.max("label").alias("label"),
        F.collect_list(F.struct("lang", "whole", "sentences")).alias("all"),
        F.max_by("lang", everyone).alias("main"),
    )
    langs = F.transform(F.filter("all", lambda x: x["whole"] > 0), lambda x: x["lang"])
    per = per.withColumn("langs", F.when(F.size(langs) > 0, langs).otherwise(F.array("main")))
    bad = F.col("label").isNull() | ~F.array_contains("langs", F.coalesce("label", F.lit(""))) | (F.size("langs") > 1)
    return per.where(bad).select(*ids, F.explode("langs").alias("lang")).distinct()
