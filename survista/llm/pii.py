r"""Surrogates for personal data (DataFrame functions only).

One pattern finds addresses of mail, network addresses, telephone, card, social-security and bank
numbers, and names after a form of address. Each entity has a key: its kind and canonical form (case,
spacing and country prefix aside), so that all its mentions agree. A keyed digest of that key makes the surrogate:
digits for digits and letters for letters of the same script and case (ASCII ones for scripts without an
alphabet here); addresses of mail and numbers that stay taken grow longer; octets in range; card and bank
numbers with the checksum class of the original; given names with the gender that the form of address
tells, or, where it tells none, the one that other mentions of the name in the corpus have more often. Words of a name
found so are replaced where they stand bare in the same text, too. Surrogates are drawn for the distinct entities of the whole corpus; one that equals another's surrogate,
or any original, is drawn again, until all are distinct. Mentions are then set in place, their own
punctuation kept.

Defined results: null text stays null and has no entity; text without entities is unchanged; overlapping
candidates go to the leftmost, then to the kind listed first; repeated rows are rewritten alike; a very
long text is rewritten whole; an empty table gives an empty table; other columns are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from survista.llm.common import discard, materialize

KEY = "survista"

EMAIL = r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]++@[\p{L}\p{M}\p{N}-]++(?:\.[\p{L}\p{M}\p{N}-]+)++"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP = rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d)(?!\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])"
#: Not the digits behind a decimal point.
CARD = r"(?<!\d)(?<!\d\.)\d(?:[ -]?\d){12,18}(?!\d)"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
#: Forms of address that tell a gender, or none.
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Госпожа", "Κυρία"]
NEUTRAL = ["Dr", "Prof"]
NAME = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(MALE + FEMALE + NEUTRAL)})\.? \p{{Lu}}[\p{{L}}'’-]+(?: \p{{Lu}}[\p{{L}}'’-]+){{0,2}}"
ENTITY = "|".join([EMAIL, NAME, IBAN, IP, SSN, PHONE, CARD])

#: Letters that stand for those of a script beyond the plain ranges of _letters.
SCRIPTS = {
    "Han": "安白北成春大德东方风高光国海和华江金景静乐林龙美明南宁平青清秋日山石水思松天文西夏祥新星雪雅阳英永玉月云正志中竹子", "Hiragana": "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ",
    "Katakana": "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ", "Hangul": "가강고구국권기김나남노단대도동라마명문미민박배보북사산서선성소송수신안양영오우원유윤은이인임장재정조주준지진창천철청최태하한해현호홍화황",
    "Arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "Hebrew": "אבגדהוזחטיכלמנסעפצקרשת", "Thai": "กขคงจฉชซญดตถทธนบปผพฟภมยรลวสหอ", "Devanagari": "अआइईउऊएओकखगघचछजझटठडढणतथदधनपफबभमयरलवशषसह",
    "Latin": "āăąćĉċčďđēĕėęěĝğġģĥīĭįĵķĺļľłńņňōŏőŕřśŝşšţťũūŭůűųŵŷźżž", "Cyrillic": "ёђѓєѕіїјљњћќўџґ", "Greek": "άέήίόύώϊϋ",
}
#: Draws of an address of mail before its local part grows by a character, and by one more after as many again; of a number, by a digit.
PATIENCE, NUMBERS = 4, 16
#: Draws after which entities without a free surrogate are an error.
ATTEMPTS = 400
#: A word as names have them.
NAME_WORD = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"

SYLLABLES = {
    "latin": (["Al", "Be", "Cor", "Da", "El", "Fa", "Ge", "Ha", "Is", "Jo", "Ka", "Lu", "Ma", "No", "Ro", "Ti"], ["ba", "de", "fi", "go", "ka", "le", "mi", "no", "ra", "se", "ti", "va", "ne", "lo", "da", "ri"], {"m": "n", "f": "na", "n": "s", "s": "ter"}),
    "cyrillic": (["Ал", "Бо", "Ва", "Да", "Ле", "Ма", "Ни", "Ро"], ["ба", "ви", "де", "ка", "ле", "ми", "но", "ра"], {"m": "н", "f": "на", "n": "с", "s": "ов"}),
    "greek": (["Αλ", "Βα", "Γε", "Δη", "Ηλ", "Κα", "Λε", "Μα"], ["βα", "γι", "δε", "κα", "λι", "μα", "νο", "ρα"], {"m": "ς", "f": "να", "n": "ν", "s": "ιδης"}),
}


def quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def entities(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), F.array().cast("array<string>"))


KIND = f"""CASE WHEN e LIKE '%@%' THEN 'email' WHEN e RLIKE {quoted("^(?:" + NAME + ")$")} THEN 'name' WHEN e RLIKE {quoted("^(?:" + IBAN + ")$")} THEN 'iban'
  WHEN e RLIKE {quoted("^(?:" + IP + ")$")} THEN 'ip' WHEN e RLIKE {quoted("^(?:" + SSN + ")$")} THEN 'ssn' WHEN e RLIKE {quoted("^(?:" + PHONE + ")$")} THEN 'phone' ELSE 'card' END"""
DIGITS = r"regexp_replace(e, '\\D', '')"
TITLE = r"regexp_extract(e, '^(\\p{L}+\\.?) ', 1)"
TOKENS = r"split(regexp_extract(e, '^\\p{L}+\\.? (.*)$', 1), ' ')"
GENDER = f"CASE WHEN replace({TITLE}, '.', '') IN ({', '.join(map(quoted, MALE))}) THEN 'm' WHEN replace({TITLE}, '.', '') IN ({', '.join(map(quoted, FEMALE))}) THEN 'f' ELSE 'n' END"
#: The keys of a mention e of kind k: one for each part that is an entity of its own.
KEYS = f"""CASE k
  WHEN 'email' THEN array(concat('email:', lower(e))) WHEN 'ip' THEN array(concat('ip:', e)) WHEN 'ssn' THEN array(concat('ssn:', {DIGITS}))
  WHEN 'card' THEN array(concat('card:', {DIGITS})) WHEN 'iban' THEN array(concat('iban:', replace(e, ' ', '')))
  WHEN 'phone' THEN array(concat('phone:', right({DIGITS}, 10)))
  ELSE transform({TOKENS}, (w, i) -> IF(i = size({TOKENS}) - 1, concat('s:', w), concat({GENDER}, ':', w))) END"""


def _number(seed: str, modulus: str) -> str:
    return f"(cast(conv(substr(sha2({seed}, 256), 1, 12), 16, 10) AS bigint) % {modulus})"


def _digits(seed: str, n: str) -> str:
    return f"substr(translate(concat(sha2(concat({seed}, '/1'), 256), sha2(concat({seed}, '/2'), 256)), 'abcdef', '012345'), 1, {n})"


def _letters(text: str, seed: str) -> str:
    """Each letter, mark and digit replaced by one of its alphabet and case; by an ASCII one where none is known."""
    pick = lambda alphabet: f"substr('{alphabet}', cast(1 + {_number(f'''concat({seed}, '/', i)''', str(len(alphabet)))} AS int), 1)"
    lower, greek, cyrillic = "abcdefghijklmnopqrstuvwxyz", "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзиклмнопрстуфхцчшэюя"
    accented = "àáâäçèéêëíîïñóôöùúûü"
    alphabets = [("0", "9", "0123456789"), ("a", "z", lower), ("A", "Z", lower.upper()), ("α", "ω", greek), ("Α", "Ω", greek.upper()), ("а", "я", cyrillic), ("А", "Я", cyrillic.upper()), ("à", "ÿ", accented), ("À", "Ý", accented.upper())]
    cases = " ".join(f"WHEN c BETWEEN '{a}' AND '{b}' THEN {pick(alphabet)}" for a, b, alphabet in alphabets)
    cases += f" WHEN c RLIKE '\\\\p{{N}}' THEN {pick('0123456789')} " + " ".join(f"WHEN c RLIKE '\\\\p{{Is{script}}}' THEN {pick(alphabet)}" for script, alphabet in SCRIPTS.items())
    cases += f" WHEN c RLIKE '[\\\\p{{L}}\\\\p{{M}}]' THEN {pick(lower)}"
    return f"array_join(transform(filter(split({text}, ''), c -> c <> ''), (c, i) -> CASE {cases} ELSE c END), '')"


def _luhn(number: str) -> str:
    x = f"cast(substr({number}, length({number}) - i + 1, 1) AS int)"
    return f"aggregate(sequence(1, length({number})), 0L, (a, i) -> a + IF(i % 2 = 0, (2 * {x}) % 10 + (2 * {x}) div 10, {x}))"


def _mod97(number: str) -> str:
    """The remainder of a number whose letters stand for 10 to 35."""
    step = "IF(c BETWEEN '0' AND '9', (a * 10 + cast(c AS bigint)) % 97, (a * 100 + ascii(c) - 55) % 97)"
    return f"aggregate(filter(split({number}, ''), c -> c <> ''), 0L, (a, c) -> {step})"


def _name(script: str, gender: str) -> str:
    first, middle, last = SYLLABLES[script]
    part = lambda xs, no: f"element_at(array({', '.join(map(quoted, xs))}), cast(1 + {_number(f'''concat(seed, '/{no}')''', str(len(xs)))} AS int))"
    more = f"array_join(transform(sequence(0, attempt), i -> element_at(array({', '.join(map(quoted, middle))}), cast(1 + {_number('''concat(seed, '/m', i)''', str(len(middle)))} AS int))), '')"
    return f"concat({part(first, 1)}, {more}, {part(middle, 2)}, '{last[gender]}')"


def surrogate(key: str) -> Column:
    """Surrogate of `kind` and `canon` at `attempt`, a canonical form of the same kind."""
    seed = f"concat({quoted(key)}, '|', kind, '|', canon, '|', attempt)"
    domain = "substring_index(canon, '@', -1)"
    kept = f"IF(size(split({domain}, '\\\\.')) > 2, 2, 1)"
    host = f"substr({domain}, 1, length({domain}) - length(substring_index({domain}, '.', -{kept})) - 1)"
    longer = f"substr(sha2(concat(seed, '/more'), 256), 1, cast(attempt div {PATIENCE} AS int))"
    email = f"concat({_letters('''substring_index(canon, '@', 1)''', 'seed')}, {longer}, '@', {_letters(host, f'''concat({quoted(key)}, '|domain|', {domain})''')}, '.', substring_index({domain}, '.', -{kept}))"
    ip = f"concat_ws('.', 1 + {_number('''concat(seed, '/a')''', '223')}, {_number('''concat(seed, '/b')''', '256')}, {_number('''concat(seed, '/c')''', '256')}, 1 + {_number('''concat(seed, '/d')''', '254')})"
    more = f"cast(attempt div {NUMBERS} AS int)"
    body = f"concat(substr(canon, 1, 1), {_digits('seed', f'length(canon) - 2 + {more}')})"
    card = f"transform(array({body}), b -> concat(b, pmod({_luhn('canon')} - {_luhn('''concat(b, '0')''')}, 10)))[0]"
    # an exchange that is not in use, while it has numbers left
    exchange = "length(canon) = 10 AND substr(canon, 4, 3) = '555' AND attempt < 2"
    phone = f"transform(array({_digits('seed', f'length(canon) + {more}')}), d -> concat(2 + cast(substr(d, 1, 1) AS int) % 8, substr(d, 2, 2), IF({exchange}, '555', substr(d, 4, 3)), substr(d, 7)))[0]"
    check = f"lpad(pmod({_mod97('concat(substr(canon, 5), substr(canon, 1, 4))')} - {_mod97('''concat(b, substr(canon, 1, 2), '00')''')}, 97), 2, '0')"
    iban = f"transform(array({_letters('substr(canon, 5)', 'seed')}), b -> concat(substr(canon, 1, 2), {check}, b))[0]"
    ssn = _digits("seed", f"9 + {more}")
    script = lambda g: f"CASE WHEN canon RLIKE '\\\\p{{IsCyrillic}}' THEN {_name('cyrillic', g)} WHEN canon RLIKE '\\\\p{{IsGreek}}' THEN {_name('greek', g)} ELSE {_name('latin', g)} END"
    names = " ".join(f"WHEN '{g}' THEN {script(g)}" for g in "mfns")
    each = f"CASE kind WHEN 'email' THEN {email} WHEN 'ip' THEN {ip} WHEN 'card' THEN {card} WHEN 'phone' THEN {phone} WHEN 'ssn' THEN {ssn} WHEN 'iban' THEN {iban} {names} END"
    return F.expr(f"transform(array({seed}), seed -> {each})[0]")


def assign(keys: DataFrame, key: str = KEY) -> DataFrame:
    """kind, canon, surrogate for the distinct rows of keys (kind, canon): surrogates are distinct within
    a kind, and none is an original of the corpus."""
    pending = materialize(keys.distinct(), "pii-entities")
    originals = pending.select("kind", F.col("canon").alias("drawn"))
    accepted, attempt = None, 0
    while True:
        drawn = pending.withColumn("attempt", F.lit(attempt)).withColumn("drawn", surrogate(key)).drop("attempt")
        free = drawn.join(originals, ["kind", "drawn"], "left_anti")
        if accepted is not None:
            free = free.join(accepted.select("kind", "drawn"), ["kind", "drawn"], "left_anti")
        first = Window.partitionBy("kind", "drawn").orderBy("canon")
        won = materialize(free.withColumn("no", F.row_number().over(first)).where("no = 1").select("kind", "canon", "drawn"), "pii-drawn")
        accepted = won if accepted is None else accepted.unionByName(won)
        pending = pending.join(won.select("kind", "canon"), ["kind", "canon"], "left_anti")
        if pending.isEmpty():
            return accepted.withColumnRenamed("drawn", "surrogate")
        if attempt == ATTEMPTS:
            raise ValueError(f"no free surrogate is left for {', '.join(sorted(r[0] for r in pending.select('kind').distinct().collect()))}")
        pending, attempt = materialize(pending, "pii-pending"), attempt + 1


#: A mention e of kind k in place, given its surrogates s in the order of its keys.
RENDER = f"""CASE k
  WHEN 'email' THEN IF(e = upper(e), upper(s[0]), s[0]) WHEN 'ip' THEN s[0]
  WHEN 'name' THEN concat_ws(' ', {TITLE}, array_join(s, ' '))
  WHEN 'iban' THEN transform(array(split(e, '[A-Z0-9]', -1)), p -> concat(array_join(zip_with(slice(p, 1, size(p) - 1), filter(split(s[0], ''), c -> c <> ''), (x, c) -> concat(x, c)), ''), p[size(p) - 1]))[0]
  ELSE transform(array(struct(split(e, '\\\\d', -1) AS p, concat(left({DIGITS}, length({DIGITS}) - length(s[0])), s[0]) AS d)),
    x -> concat(array_join(zip_with(slice(x.p, 1, size(x.p) - 1), slice(filter(split(x.d, ''), c -> c <> ''), 1, size(x.p) - 1), (y, c) -> concat(y, c)), ''), substr(x.d, size(x.p)), x.p[size(x.p) - 1]))[0] END"""
#: A piece p of text between entities, split into `gaps` and `words`, with the words of the map `_bare` replaced.
BARE = """array_join(zip_with(gaps, words, (g, w) -> concat(g, coalesce(coalesce(_bare[w], IF(w RLIKE "['’]s$", concat(_bare[left(w, length(w) - 2)], right(w, 2)), NULL)), w, ''))), '')"""


def _known_genders(pairs: DataFrame) -> DataFrame:
    """pairs with given names after a neutral form of address under the gender that most other mentions of the name tell."""
    told = pairs.where("kind IN ('m', 'f')").groupBy("canon").agg(F.expr("IF(count_if(kind = 'f') >= count_if(kind = 'm'), 'f', 'm')").alias("told"))
    neutral = pairs.where("kind = 'n'").join(told, "canon", "left").withColumn("kind", F.coalesce("told", "kind"))
    return pairs.where("kind <> 'n'").unionByName(neutral.select(pairs.columns))


def replace_entities(docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs with entities in `text` replaced, and n_entities added. Texts without entities are not shuffled."""
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("_text"))
    tagged = src.withColumn("_found", entities(F.col("_text"))).withColumn("_no", F.monotonically_increasing_id())
    tagged = materialize(tagged.drop("_text"), "pii-tagged")
    some = tagged.where(F.size("_found") > 0)
    keyed = some.select("_no", F.explode(F.array_distinct("_found")).alias("e")).withColumn("k", F.expr(KIND)).withColumn("keys", F.expr(KEYS))
    pairs = keyed.select("_no", F.posexplode("keys").alias("i", "key"), "e", "k")
    pairs = pairs.select("_no", "e", "k", "i", F.substring_index("key", ":", 1).alias("kind"), F.expr("substr(key, instr(key, ':') + 1)").alias("canon"))
    mentions = materialize(pairs, "pii-mentions")
    pairs = materialize(_known_genders(mentions), "pii-keys")
    discard(mentions)
    table = assign(pairs.select("kind", "canon"), key)
    parts = pairs.join(table, ["kind", "canon"]).groupBy("_no", "e", "k").agg(F.sort_array(F.collect_list(F.struct("i", "surrogate", "canon"))).alias("s"))
    bare = F.expr("IF(k = 'name', transform(s, x -> struct(x.canon AS word, x.surrogate AS `to`)), array())").alias("bare")
    ready = parts.select("_no", "e", "k", bare, F.expr("transform(s, x -> x.surrogate)").alias("s")).select("_no", F.struct("e", F.expr(RENDER).alias("to")).alias("pair"), "bare")
    # a word that is a given name here and a surname there has one surrogate where it stands bare
    one = "array_sort(flatten(collect_list(bare)), (x, y) -> CASE WHEN x < y THEN -1 WHEN x > y THEN 1 ELSE 0 END)"
    maps = ready.groupBy("_no").agg(F.map_from_entries(F.collect_list("pair")).alias("_map"), F.expr(one).alias("bare"))
    maps = maps.select("_no", "_map", F.expr("map_from_entries(filter(bare, (x, i) -> i = 0 OR bare[i - 1].word <> x.word))").alias("_bare"))
    pieces = F.split(F.col("_row.text"), ENTITY, -1)
    new = some.join(maps, "_no").withColumn("_parts", pieces)
    words = f"""transform(_parts, p -> struct(split(p, {quoted(NAME_WORD)}, -1) AS gaps, regexp_extract_all(p, {quoted(NAME_WORD)}, 0) AS words))"""
    spoken = f"""transform({words}, q -> {BARE.replace('gaps', 'q.gaps').replace('words', 'q.words')})"""
    new = new.withColumn("_parts", F.expr(f"IF(size(_bare) > 0, {spoken}, _parts)"))
    text = F.expr("concat(array_join(zip_with(slice(_parts, 1, size(_found)), _found, (p, e) -> concat(p, _map[e])), ''), _parts[size(_found)])")
    columns = lambda body: [body.alias("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns]
    done = new.select(*columns(text), F.size("_found").alias("n_entities"))
    none = tagged.where(F.size("_found") == 0).select(*columns(F.col("_row.text")), F.lit(0).alias("n_entities"))
    return none.unionByName(done) if len(set(docs.columns)) == len(docs.columns) and "n_entities" not in docs.columns else none.union(done)


def without_entities(docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs with entities in `text` replaced, all columns as they were; `n_chars`, where there is one, follows a new text."""
    mine = [f"_c{i}" for i in range(len(docs.columns))]
    new = replace_entities(docs, key).toDF(*mine, "_n")
    text = F.col(mine[docs.columns.index("text")])
    follow = lambda m, c: F.when(F.col("_n") > 0, F.length(text).cast(docs.schema[c].dataType)).otherwise(F.col(m)) if c == "n_chars" else F.col(m)
    return new.select(*[follow(m, c).alias(c) for m, c in zip(mine, docs.columns, strict=True)])


def op6_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    return replace_entities(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
