"""Problem 7: spellings of persons and organisations, linked to the entries of a registry.

Method: MinHash banding over padded q-grams finds, for each distinct token of the spelled names, the registry's tokens that
it may stand for; bands and rows are tuned from the collision curve (recall at the least similarity of a true pair, then
fewest chance collisions). An entry is a candidate for a name that meets one of its rare tokens. Where a family name's word
is in more than ``COMMON`` entries, or an organisation has common words only, pairs have to be met: the family name with an
initial that a spelling of the given name may have (its own, those of the names it is short for or that are short for it, and
what a slip makes of it), or two words; so no name meets all bearers. A family name that stands alone means its bearer if
there is one only: it meets two bearers at most, as two tie. Candidates are verified by a symmetric
Monge-Elkan similarity whose token similarity knows initials, short forms, transposed letters and lost accents. Star
clustering: the entries are the star centres, each spelling joins the centre it is most similar to, none if the best is
below the threshold or two centres tie.

The registry is a table of any size: it meets names by joins and is sent to no task. So do its given names, by which a comma
behind a family name is read: each list gets those of its own words that are given names, however rare they are.

Distinct spellings are compared, not mentions, so a name that fills a third of the rows is looked up once. Null or
empty names give no row. Repeated rows count once.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm._arrow import map_batches
from foliant.llm.words import GONE, LOOK
from foliant.session import cut

Q, COMMON, LEAST, RECALL, CHANCE, MAX_HASHES, ACCEPT, TOKEN = 2, 12, 0.4, 0.995, 0.1, 240, 0.86, 0.66
# Short forms of given names in English, Spanish, German and French use, and of kinds of institution.
HYPOCORISTICS = """
abigail: abby gail; abraham: abe bram; adelheid: heidi; agnes: aggie; albert: al bert bertie; alberto: beto tito; alejandro: alex jandro; alexander: alex sandy sasha xander sascha; alexandra: alex sandra sasha lexi; alfred: alf fred alfie;
alfredo: fredo; amelia: millie; andrew: andy drew; andreas: andy; angela: angie; anna: annie anya anita; anthony: tony; antonio: tono toni tonio; antonia: toni; arthur: art artie; augustus: gus; barbara: barb babs; beatrice: bea trixie; benjamin: ben benny;
benoit: ben; bernard: bernie; bernhard: bernd; bettina: tina; bradley: brad; caroline: caro carrie; carolina: caro; catherine: cathy kate katie cat; cecilia: ceci; charles: charlie chuck; charlotte: lotte charlie; christian: chris; christina: tina chris; christine: chris tina;
christopher: chris kit; concepcion: concha conchita; cynthia: cindy; daniel: dan danny dani; david: dave davy; deborah: deb debbie; dolores: lola; donald: don donnie; dorothea: dora thea; dorothy: dot dottie; eduardo: edu lalo; edward: ed eddie ned ted; eleanor: ellie nell nora;
elisabeth: lisa liesl sissi; elizabeth: liz beth betty lisa eliza lizzie; emily: em emmy; enrique: quique; ernesto: neto; eugene: gene; federico: fede; felicity: fliss; fernando: nando; florence: flo; francisco: paco pancho curro; francis: frank; franziska: franzi; frederick: fred freddy;
friedrich: fritz; gabriel: gabe gabi; gerald: gerry; gerhard: gerd; gertrude: trudy; gregory: greg; guadalupe: lupe; guillermo: memo guille; gustavo: gus tavo; hannelore: hanne; harold: harry hal; heinrich: heinz heiner; helen: nell; helena: lena; helene: helen lena; henry: harry hank;
ignacio: nacho; irene: renie; isabel: isa bella; isabella: bella isa; jacob: jake; jacqueline: jackie; james: jim jimmy jamie; janet: jan; jennifer: jen jenny; jeremy: jerry; jessica: jess; jesus: chucho; johann: hans; johannes: hans hannes jan; john: jack johnny; jonathan: jon;
jorge: coque; jose: pepe; josefa: pepa; joseph: joe joey; josephine: jo josie; joshua: josh; juan: juancho; juergen: jurgen; judith: judy; julia: jule; karl: kalle; katharina: kathi kate; katherine: kate kathy katie kat kay; kenneth: ken kenny; kimberly: kim; lawrence: larry; leonard: len lenny;
leonardo: leo; lucia: lucy lucie; luis: lucho; magdalena: magda lena; manuel: manolo manu; margaret: peggy maggie meg greta marge; margarete: grete gretel; maria: mia mitzi; mariana: nana; martha: marty; matthew: matt; matthias: matze; maximilian: max; mercedes: merche; michael: mike mick mickey;
miguel: migue; natalia: nat natasha talia tasha; natalie: nat; nathaniel: nat nate; nicholas: nick nicky; nikolaus: klaus niko; olga: olya; pamela: pam; patricia: pat patty tricia; patrick: pat paddy; peter: pete; philip: phil pip; quentin: quin; rafael: rafa; raymond: ray; rebecca: becky;
ricardo: richi; richard: dick rick rich; robert: bob rob bobby; roberto: beto; ronald: ron ronnie; rosario: charo; samuel: sam sammy; santiago: santi; sebastian: seb basti; sergio: checo; stefan: steffen; stephanie: steph steffi; stephen: steve; susan: sue susie; susanna: sue susie; susanne: susi;
teresa: tere; theodora: theo dora; theodore: ted theo; theresa: terry tess; thomas: tom tommy; timothy: tim; ulrich: uli ulli; ulrike: uli ulli rike; valentina: vale; veronica: vero; victor: vic; victoria: vicky vicki tori; vincent: vince vinny; virginia: ginny; walter: walt; wilhelm: willi; william: bill will billy liam;
wolfgang: wolf; xavier: xavi javi; javier: javi; yolanda: yoli; zachary: zach
"""
SHORT: dict[str, frozenset[str]] = {}
for _full, _shorts in (x.split(":") for x in HYPOCORISTICS.replace("\n", " ").split(";")):
    for _s in _shorts.split():
        SHORT[_s] = SHORT.get(_s, frozenset()) | {_full.strip()}


def meant(given: str) -> frozenset[str]:
    """A given name and those it is short for."""
    return SHORT.get(given, frozenset()) | {given}


def related(given: str) -> frozenset[str]:
    """A given name and all that may be written for it: what it is short for, and the short forms of these."""
    full = meant(given)
    return full | frozenset(s for s, of in SHORT.items() if of & full)


KINDS = {"lab": "laboratory", "labs": "laboratory", "inst": "institute", "cons": "consortium", "consort": "consortium", "wg": "working group", "grp": "group", "ctr": "center", "univ": "university", "dept": "department", "assoc": "association", "res": "research", "intl": "international"}
SMALL = frozenset("for of on and the in".split())
TITLES = frozenset("dr prof mr mrs ms sir dame phd md jr sr the".split())
PARTICLES = frozenset("de da do dos das del della di van von der den la le du ter ten el al".split())
EVERY = re.compile(r"\s*[;|]\s*|\s+(?:&|and|und|et)\s+")


def fold(name: str) -> str:
    """Lower case without accents, invisible signs and look-alike letters."""
    s = name.translate(GONE)
    if not s.isascii():
        s = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", s.translate(LOOK) if re.search("[A-Za-z]", s) else s))
        s = "".join(c for c in s if not unicodedata.combining(c)).replace("ß", "ss").replace("ø", "o").replace("ł", "l")
    return s.lower()


def tokens(name: str) -> list[str]:
    """Folded tokens without titles; initials run together are parted; short forms of institutions are written out."""
    out: list[str] = []
    for t in re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*\.?", fold(name)):
        dot, t = t.endswith("."), t.rstrip(".")
        if t in TITLES:
            continue
        out += KINDS[t].split() if t in KINDS and (dot or t == "wg") or t in KINDS and len(t) > 3 else [t]
    return out


def is_initials(part: str) -> bool:
    return bool(re.fullmatch(r"(?:[^\W\d_]\.?[\s-]*){1,4}", part.strip()))


def parts_of(authors: str) -> list[list[str]]:
    """The parts of a list between signs that part names in any case, each cut at its commas."""
    return [[p for p in (x.strip() for x in part.split(",")) if p] for part in EVERY.split(authors)]


def may_be_family(piece: str) -> bool:
    return sum(fold(w).strip(".") not in PARTICLES | TITLES for w in piece.split()) == 1


def asked_given(authors: str) -> set[str]:
    """The words by which ``split_names`` reads a list's commas if they are given names; what they are short for among them."""
    out: set[str] = set()
    for pieces in parts_of(authors):
        for now, nxt in zip(pieces, pieces[1:]):
            if may_be_family(now) and not is_initials(nxt):
                out.update(g for t in tokens(nxt) if len(t) > 1 for g in meant(t))
    return out


def split_names(authors: str, given: frozenset[str]) -> list[str]:
    """The names of a list. A comma parts two names unless what follows it is initials or given names of the family name before it.
    given: given names, of which only those in ``asked_given`` count."""
    out: list[str] = []
    for pieces in parts_of(authors):
        k = 0
        while k < len(pieces):
            now = pieces[k]
            if k + 1 < len(pieces):
                nxt = pieces[k + 1]
                nt = tokens(nxt)
                after_given = bool(nt) and all(len(t) == 1 or meant(t) & given for t in nt)
                if is_initials(nxt) or may_be_family(now) and after_given or not nt:
                    now, k = f"{now}, {nxt}", k + 1
            out.append(now)
            k += 1
    return [x for x in (y.strip() for y in out) if x]


def curve(rows: int, bands: int, similarity: float) -> float:
    return 1 - (1 - similarity**rows) ** bands


def tune(least: float = LEAST, recall: float = RECALL, chance: float = CHANCE, most: int = MAX_HASHES) -> tuple[int, int]:
    """Rows and bands: the fewest chance collisions among those that reach the recall within ``most`` hashes."""
    best = None
    for r in range(1, 9):
        for b in range(1, most // r + 1):
            if curve(r, b, least) >= recall:
                if best is None or curve(r, b, chance) < curve(*best, chance):
                    best = (r, b)
                break
    return best or (1, most)


ROWS, BANDS = tune()
_rng = np.random.default_rng(11)
A, B = _rng.integers(1, 1 << 61, ROWS * BANDS, dtype=np.uint64) | np.uint64(1), _rng.integers(0, 1 << 61, ROWS * BANDS, dtype=np.uint64)


def bands(token: str) -> list[int]:
    """The band keys of a token's padded q-grams."""
    p = "^" * (Q - 1) + token + "$" * (Q - 1)
    grams = np.array(sorted({int.from_bytes(p[i : i + Q].encode("utf-32-le"), "little") & 0xFFFFFFFFFFFF for i in range(len(p) - Q + 1)}), dtype=np.uint64)
    h = ((grams[:, None] * A[None, :]) ^ (grams[:, None] >> np.uint64(17))) + B[None, :]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    low = h.min(axis=0).reshape(BANDS, ROWS)
    key = np.full(BANDS, 1469598103934665603, dtype=np.uint64)
    for r in range(ROWS):
        key = (key ^ low[:, r]) * np.uint64(1099511628211)
    key ^= np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return key.view(np.int64).tolist()


def edit(a: str, b: str, most: int = 3) -> int:
    """Edit distance with transpositions, ``most + 1`` if larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if two and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


def alike(a: str, b: str) -> float:
    """Token similarity: 1 equal, .96 short form, .94 initial, else by edit distance; 0 below one edit in three letters."""
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        return 0.94 if a[0] == b[0] else 0.0
    if (a in SHORT or b in SHORT) and meant(a) & meant(b):
        return 0.96
    n = max(len(a), len(b))
    if abs(len(a) - len(b)) > 3 or len(set(a) ^ set(b)) > 6 or a[0] != b[0] and a[-1] != b[-1] and a[1] != b[0] and a[0] != b[1]:
        return 0.0  # too different for the distances that count
    d = edit(a, b)
    return 1 - d / n if d <= 2 and 3 * d <= n or d == 3 and n >= 12 else 0.0


def person_similarity(spelled: list[str], given: list[str], family: list[str]) -> float:
    """Monge-Elkan over the family tokens, then over the given ones of what is left; a given name or initial that contradicts gives 0."""
    left = list(spelled)
    if any(len(t) > 1 for t in left):
        left = [t for t in left if t not in PARTICLES] or left
    fam = [t for t in family if t not in PARTICLES] or family
    total = 0.0
    for f in fam:
        best = max(((alike(t, f), -k) for k, t in enumerate(left) if len(t) > 1), default=(0.0, 0))
        if best[0] < TOKEN:
            return 0.0
        total += best[0]
        left.pop(-best[1])
    score = total / len(fam)
    if not left:
        return 0.6 * score + 0.24  # the family name alone: right only if it is the only one
    pairs = []
    rest = list(given)
    for t in left:
        best = max(((alike(t, g), -k) for k, g in enumerate(rest)), default=(0.0, 0))
        if best[0] > 0:
            pairs.append(best[0])
            rest.pop(-best[1])
        elif len(t) == 1 and rest is not None and len(given) == 1 and pairs:
            pairs.append(0.8)  # a middle initial the registry doesn't have
        else:
            return 0.0
    if given and rest and given[0] in rest:  # the first given name is not among what is written
        return 0.0
    missing = 0.01 * len(rest)
    return 0.6 * score + 0.4 * sum(pairs) / len(pairs) - missing


def acronyms(full: list[str]) -> tuple[str, str]:
    """The initials of the main words, and the same with the second letter of the first word behind."""
    main = [t for t in full if t not in SMALL]
    short = "".join(t[0] for t in main)
    return short, short + main[0][1:2] if main else ""


def organisation_similarity(spelled: list[str], full: list[str], rare: set[str]) -> float:
    """Symmetric Monge-Elkan over all tokens; the rare ones must be met."""
    a, b = [t for t in spelled if t not in SMALL], [t for t in full if t not in SMALL]
    if not a or not b:
        return 0.0
    if len(a) == 1 and 2 < len(a[0]) <= len(b) + 1:
        short, long = acronyms(full)
        if a[0] in (short, long):
            return 0.95 if a[0] == long else 0.9
    best = {g: max(alike(t, g) for t in a) for g in b}
    if any(best[g] < TOKEN for g in rare if g in best):
        return 0.0
    back = sum(max(alike(t, g) for g in b) for t in a) / len(a)
    return (sum(best.values()) / len(b) + back) / 2


def key_tokens(toks: list[str], fam: list[str]) -> list[str]:
    """The tokens that say who is meant: of the family name, or of an organisation's name."""
    if fam:
        return [t for t in fam if t not in PARTICLES] or fam
    return [t for t in toks if t not in SMALL] or toks


ENTRY = "author_id bigint, full_name string, family_name string, toks array<string>, fam array<string>, look array<string>"


def entries_of(registry: DataFrame, key: str, full: str, family: str) -> DataFrame:
    """The registry's entries with their tokens. ``look``: the tokens under which an entry may be found, acronyms of organisations among them."""

    def make():
        def work(b: pa.RecordBatch) -> dict:
            toks, fams, look = [], [], []
            for name, family_name in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                t, f = tokens(name), tokens(family_name) if family_name else []
                toks.append(t)
                fams.append(f)
                look.append(list(dict.fromkeys(key_tokens(t, f) + ([] if f else [a for a in acronyms(t) if len(a) > 2]))))
            lists = pa.list_(pa.string())
            return {"author_id": b.column(0), "full_name": b.column(1), "family_name": b.column(2), "toks": pa.array(toks, lists), "fam": pa.array(fams, lists), "look": pa.array(look, lists)}

        return work

    rows = registry.where(F.col(key).isNotNull() & F.col(full).isNotNull()).select(F.col(key).cast("bigint").alias("author_id"), F.col(full).alias("full_name"), F.col(family).alias("family_name")).distinct()
    made = map_batches(rows, make, ENTRY)
    # tokens that many entries share: they don't tell entries apart by themselves
    many = made.select(F.explode(F.array_distinct("toks")).alias("t")).groupBy("t").count().where(F.col("count") > COMMON).select("t")
    shared = made.select("author_id", "full_name", F.explode(F.array_distinct(F.concat("toks", "look"))).alias("t")).join(many, "t").groupBy("author_id", "full_name").agg(F.collect_set("t").alias("shared"))
    return made.join(shared, ["author_id", "full_name"], "left").withColumn("shared", F.coalesce("shared", F.array().cast("array<string>")))


def given_names(entries: DataFrame) -> DataFrame:
    """(g): every given name of the registry."""
    return entries.where("size(fam) > 0").select(F.explode(F.array_distinct(F.array_except("toks", "fam"))).alias("g")).where("length(g) > 1").distinct()


def known_given(entries: DataFrame) -> frozenset[str]:
    """All given names of a registry as a set, to part single lists on the driver; tables of lists meet ``given_names`` by a join."""
    return frozenset(r.g for r in given_names(entries).toLocalIterator())


def token_bands(tokens_of: DataFrame, name: str) -> DataFrame:
    """(token, band) of distinct tokens."""

    def make():
        def work(b: pa.RecordBatch) -> dict:
            keys = [bands(t) for t in b.column(0).to_pylist()]
            return {name: b.column(0).take(pa.array(np.repeat(np.arange(len(keys)), BANDS))), "band": pa.array([k for ks in keys for k in ks], pa.int64())}

        return work

    return map_batches(tokens_of.select(name), make, f"{name} string, band bigint")


def matching_tokens(spelled: DataFrame, known: DataFrame) -> DataFrame:
    """(t, f): spelled tokens and the registry's tokens they may stand for. Distinct tokens meet by their bands; ``alike`` verifies."""
    near = token_bands(spelled, "t").join(token_bands(known, "f"), "band").select("t", "f").where(F.abs(F.length("t") - F.length("f")) <= 3).distinct()

    def make():
        def work(b: pa.RecordBatch) -> dict:
            ok = pa.array([alike(t, f) >= TOKEN for t, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], pa.bool_())
            return {"t": b.column(0).filter(ok), "f": b.column(1).filter(ok)}

        return work

    return map_batches(near, make, "t string, f string")


def filed_under(entries: DataFrame) -> DataFrame:
    """(key, author_id, full_name): an entry stands under each of its rare tokens; without one under pairs, a family name with an initial or two words.
    Two bearers of a common family name stand under it alone."""

    def make():
        letters: dict[str, frozenset[str]] = {}

        def work(b: pa.RecordBatch) -> dict:
            row, keys = [], []
            for i, (toks, fam, look, shared) in enumerate(zip(*(b.column(k).to_pylist() for k in range(2, 6)))):
                mine = [t for t in look if t not in shared]
                if fam and (not mine or len(mine) < len(look)):
                    for g in toks:
                        if g not in letters:
                            letters[g] = frozenset(x[0] for x in related(g))
                    given = frozenset().union(*(letters[g] for g in toks if g not in fam))
                    mine += [f"{f}|{g}" for f in look if f in shared for g in given]
                elif not fam and not any(t in toks for t in mine):  # acronyms at most
                    words = [t for t in look if t in toks]
                    mine += [f"{x}|{y}" for x in words for y in words if x < y] or words
                row += [i] * len(mine)
                keys += mine
            take = pa.array(row, pa.int64())
            return {"key": pa.array(keys, pa.string()), "author_id": b.column(0).take(take), "full_name": b.column(1).take(take)}

        return work

    filed = map_batches(entries.select("author_id", "full_name", "toks", "fam", "look", "shared"), make, "key string, author_id bigint, full_name string")
    one = F.size("look") == 1, F.size(F.filter("fam", lambda t: F.array_contains("look", t))) == 1
    bearers = entries.where(one[0] & one[1]).select(F.col("look")[0].alias("f"), "shared", F.struct("author_id", "full_name").alias("e")).where("array_contains(shared, f)")
    two = bearers.groupBy("f").agg(F.array_distinct(F.array(F.min("e"), F.max("e"))).alias("e")).select(F.concat("f", F.lit("|")).alias("key"), F.explode("e").alias("e"))
    return filed.unionByName(two.select("key", "e.author_id", "e.full_name"))


def looked_up(named: DataFrame) -> DataFrame:
    """(name, key) of names ``name, toks, met array<struct<t, f>>``: the tokens met, each with the initials of the others and of what those
    may stand for, or alone if there are no others, and pairs of them."""

    def make():
        def work(b: pa.RecordBatch) -> dict:
            row, keys = [], []
            for i, (toks, met) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                mine = {m["f"] for m in met}
                alone = len([t for t in toks if t not in PARTICLES] or toks) == 1
                for m in met:
                    others = list(toks)
                    others.remove(m["t"])
                    mine |= {f"{m['f']}|{t[0]}" for t in others} | {f"{m['f']}|{x['f'][0]}" for x in met if x["t"] in others}
                    if alone:
                        mine.add(f"{m['f']}|")
                mine |= {f"{x['f']}|{y['f']}" for x in met for y in met if x["t"] != y["t"] and x["f"] < y["f"]}
                row += [i] * len(mine)
                keys += mine
            return {"name": b.column(0).take(pa.array(row, pa.int64())), "key": pa.array(keys, pa.string())}

        return work

    return map_batches(named.select("name", "toks", "met"), make, "name string, key string")


def link(names: DataFrame, name: str, entries: DataFrame) -> DataFrame:
    """The entry that each distinct name means: ``name, author_id bigint, full_name, family_name, similarity double``; unlinked names have no row."""

    def make_tokens():
        def work(b: pa.RecordBatch) -> dict:
            return {"name": b.column(0), "toks": pa.array([tokens(x) for x in b.column(0).to_pylist()], pa.list_(pa.string()))}

        return work

    distinct = names.where(F.col(name).isNotNull()).select(F.col(name).alias("name")).distinct()
    spelled = cut(map_batches(distinct, make_tokens, "name string, toks array<string>"))
    each = spelled.select("name", F.explode(F.array_distinct("toks")).alias("t")).where("length(t) > 1")
    met = matching_tokens(each.select("t").distinct(), entries.select(F.explode("look").alias("f")).unionByName(given_names(entries).withColumnRenamed("g", "f")).distinct())
    per_name = each.join(met, "t").groupBy("name").agg(F.collect_set(F.struct("t", "f")).alias("met")).join(spelled, "name")
    found = looked_up(per_name).join(filed_under(entries), "key").select("name", "author_id", "full_name")
    exact = spelled.join(entries, F.col("name") == F.col("full_name")).select("name", "author_id", "full_name")
    facts = found.unionByName(exact).distinct().join(spelled.withColumnRenamed("toks", "spelled"), "name").join(entries.withColumnRenamed("toks", "known"), ["author_id", "full_name"])

    def make():
        def work(b: pa.RecordBatch) -> dict:
            score = []
            for n, full, toks, known, fam, shared in zip(*(b.column(k).to_pylist() for k in (0, 2, 4, 5, 6, 7))):
                given = [t for t in known if t not in fam] if fam else []
                rare = {t for t in key_tokens(known, fam) if t not in shared} or set(known)
                score.append(2.0 if n == full else person_similarity(toks, given, fam) if fam else organisation_similarity(toks, known, rare))
            return {"name": b.column(0), "author_id": b.column(1), "full_name": b.column(2), "family_name": b.column(3), "similarity": pa.array(score, pa.float64())}

        return work

    scored = map_batches(facts.select("name", "author_id", "full_name", "family_name", "spelled", "known", "fam", "shared"), make, "name string, author_id bigint, full_name string, family_name string, similarity double")
    scored = scored.where(F.col("similarity") >= 0.7)
    # star clustering: the best centre, if it is good enough and stands alone; a family name alone passes if it has one bearer
    best = F.max_by(F.struct("author_id", "full_name", "family_name"), "similarity")
    per = scored.groupBy("name").agg(best.alias("e"), F.max("similarity").alias("similarity"), F.sort_array(F.collect_list("similarity"), asc=False).alias("all"))
    alone = (F.size("all") == 1) | (F.get("all", F.lit(0)) - F.get("all", F.lit(1)) > 0.012)
    return per.where(((F.col("similarity") >= ACCEPT) | (F.size("all") == 1)) & alone).select("name", "e.author_id", "e.full_name", "e.family_name", "similarity")


def mentions(papers: DataFrame, paper: str, authors: str, given: DataFrame) -> DataFrame:
    """(paper, author_pos, name) of every name in the lists. given: ``given_names`` of the registry."""
    kind = dict(papers.dtypes)[paper]

    def make_asked():
        def work(b: pa.RecordBatch) -> dict:
            asked = [sorted(asked_given(a)) for a in b.column(1).to_pylist()]
            return {"__k": b.column(0).take(pa.array(np.repeat(np.arange(len(asked)), [len(x) for x in asked]))), "g": pa.array([g for x in asked for g in x], pa.string())}

        return work

    def make():
        def work(b: pa.RecordBatch) -> dict:
            row, pos, names = [], [], []
            for i, (a, known) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                for k, x in enumerate(split_names(a, frozenset(known or ())), 1):
                    row.append(i)
                    pos.append(k)
                    names.append(x)
            return {paper: b.column(0).take(pa.array(row, pa.int64())), "author_pos": pa.array(pos, pa.int32()), "name": pa.array(names, pa.string())}

        return work

    rows = papers.where(F.col(authors).isNotNull()).select(F.col(paper).alias("__p"), F.col(authors).alias("__a"), F.sha2(authors, 256).alias("__k")).distinct()
    lists = rows.where(F.contains("__a", F.lit(","))).select("__k", "__a").distinct()
    known = map_batches(lists, make_asked, "__k string, g string").join(given, "g").groupBy("__k").agg(F.collect_set("g").alias("__g"))
    return map_batches(rows.join(known, "__k", "left").select("__p", "__a", "__g"), make, f"`{paper}` {kind}, author_pos int, name string")


def link_papers(papers: DataFrame, paper: str, authors: str, year: str, key: str, registry: DataFrame, ids: tuple[str, str, str] = ("author_id", "full_name", "family_name")) -> DataFrame:
    """All links: ``paper, author_pos, author_id, exact boolean``; position 0 is the citation key (of the first author, if a person).
    registry: with the columns ``ids``; the family name is null for organisations."""
    entries = cut(entries_of(registry, *ids))
    named = mentions(papers, paper, authors, given_names(entries))
    found = named.join(link(named, "name", entries), "name").withColumn("exact", F.col("name") == F.col("full_name"))
    keys = papers.where(F.col(key).isNotNull()).select(paper, F.col(key).alias("__k"), F.coalesce(year, F.lit("????")).alias("__y")).distinct()
    first = found.where("author_pos = 1 and family_name is not null").select(paper, "author_id", "family_name")
    by_key = keys.join(first, paper).select(paper, F.lit(0).alias("author_pos"), "author_id", (F.col("__k") == F.concat("family_name", "__y")).alias("exact"))
    return found.select(paper, "author_pos", "author_id", "exact").unionByName(by_key)
