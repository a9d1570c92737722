"""Personal data to format-preserving Feistel pseudonyms. SQL functions only.

Each find is validated (card numbers by check digit, IPv4 by range and the lack of leading zeros, dates by range, social security
numbers by their parts, phone numbers by shape) and read as a pair of numbers (l, r) below (ml, mr); a keyed Feistel network
permutes the pairs, alternately adding a keyed hash of one half to the other, and the result is written back in the find's own
format. The permutation is the same everywhere and maps each kind of number onto itself, so equal values get equal pseudonyms in
all documents and different values different ones. Card numbers keep length, first digit and a right check digit; social security
numbers stay valid ones; dates stay real dates of 1900 to 2099 (numbers outside the range are walked on); phone numbers keep
punctuation and +1, and those with area and exchange from 200 on, as well as all others, stay among their like. E-mail local parts
and secrets, which are not numbers, become keyed digests of the same alphabet, and e-mail domains stay.

Defined results: a null text stays null, an empty one empty; text that is no valid find is untouched and not counted, so clean
texts come back equal; repeated rows are treated alike; an empty table gives an empty result; other columns of any name are
carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY, ROUNDS = "example-key-1", 8

# Each starts at a token's start and repeats possessively, so that matching is linear in the text.
EMAIL = r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
SECRET = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![A-Za-z0-9])|(?<=(?:password|passwd|secret|api_key|token)=)[A-Za-z0-9]{8,64}(?![A-Za-z0-9])"
IPV4 = r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"
CARD = r"(?<![0-9A-Za-z.-])(?:[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9A-Za-z]|[.-][0-9])"
SSN = r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|[.-][0-9])"
PHONE = r"(?<![0-9A-Za-z.)+-])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])"
DATE = r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9A-Za-z]|[./-][0-9])"
FINDS = "|".join((EMAIL, SECRET, IPV4, SSN, CARD, PHONE, DATE))
#: Each find holds one of these: an e-mail its sign, each secret its letters or name, an IPv4 a point between digits, all other
#: numbers two digits side by side. So a text without any of them holds no find.
HINT = r"@|[0-9]{2}|[0-9]\.[0-9]|AKIA|[0-9a-f]{32}|(?:password|passwd|secret|api_key|token)="
DAYS, DAY_L, DAY_R = 73049, 271, 270


def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _hash(tag: str, i: int, half: str, m: str, key: str) -> str:
    return f"(cast(conv(substr(sha2(concat_ws(':', {_q(key)}, {tag}, '{i}', {half}), 256), 1, 15), 16, 10) AS bigint) % {m})"


def feistel(v: str, key: str = KEY, rounds: int = ROUNDS) -> str:
    """SQL for the permuted pair of a struct v (tag, l, r, ml, mr): a bijection of [0, ml) x [0, mr) for each tag."""
    out = v
    for i in range(rounds):
        l, r = (f"pmod(p.l + {_hash('p.tag', i, 'p.r', 'p.ml', key)}, p.ml)", "p.r") if i % 2 == 0 else ("p.l", f"pmod(p.r + {_hash('p.tag', i, 'p.l', 'p.mr', key)}, p.mr)")
        out = f"transform(array({out}), p -> named_struct('tag', p.tag, 'l', {l}, 'r', {r}, 'ml', p.ml, 'mr', p.mr))[0]"
    return out


def _digits(d: str, tag: str) -> str:
    """Struct of a string of up to 18 digits, halved."""
    n = f"char_length({d})"
    return f"named_struct('tag', concat({tag}, {n}), 'l', cast(left({d}, {n} div 2) AS bigint), 'r', cast(right({d}, {n} - {n} div 2) AS bigint), 'ml', cast(pow(10, {n} div 2) AS bigint), 'mr', cast(pow(10, {n} - {n} div 2) AS bigint))"


def _joined(p: str, n: str) -> str:
    return f"concat(lpad(cast({p}.l AS string), {n} div 2, '0'), lpad(cast({p}.r AS string), {n} - {n} div 2, '0'))"


def _refill(m: str, digits: str) -> str:
    """m with its digits, in order, taken from digits."""
    return f"aggregate(split({m}, ''), named_struct('o', '', 'k', 1), (a, c) -> IF(c RLIKE '[0-9]', named_struct('o', concat(a.o, substr({digits}, a.k, 1)), 'k', a.k + 1), named_struct('o', concat(a.o, c), 'k', a.k))).o"


def luhn_sum(d: str) -> str:
    """Sum of digits, every second from the right doubled; a right number's is divisible by ten."""
    x = f"cast(substr({d}, char_length({d}) - i + 1, 1) AS int)"
    return f"aggregate(sequence(1, char_length({d})), 0, (s, i) -> s + IF(i % 2 = 1, {x}, 2 * {x} - IF({x} > 4, 9, 0)))"


def pseudonym(m: str, key: str = KEY) -> str:
    """SQL for the pseudonym of one find m, null if it does not validate."""
    digest = f"sha2(concat_ws(':', {_q(key)}, {m}), 256)"
    d = f"regexp_replace({m}, '[^0-9]', '')"
    email = f"concat('u', substr(sha2(concat_ws(':', {_q(key)}, lower({m})), 256), 1, 12), substring({m}, locate('@', {m})))"
    aws = f"concat('AKIA', upper(substr({digest}, 1, 16)))"
    other = f"substr({digest}, 1, char_length({m}))"
    parts = f"transform(split({m}, '[.]'), x -> cast(x AS bigint))"
    pair = feistel("named_struct('tag', 'ip', 'l', a[0] * 256 + a[1], 'r', a[2] * 256 + a[3], 'ml', 65536L, 'mr', 65536L)", key)
    ip = f"transform(array({parts}), a -> IF(exists(a, x -> x > 255) OR {m} RLIKE '(^|[.])0[0-9]', null, transform(array({pair}), p -> concat_ws('.', p.l div 256, p.l % 256, p.r div 256, p.r % 256))[0]))[0]"
    # Card: the first digit stays, the last is made right, those between are permuted.
    body = feistel(_digits("b", "concat('card', left(d, 1), '-')"), key)
    inner = f"transform(array(substr(d, 2, char_length(d) - 2)), b -> transform(array({body}), p -> concat(left(d, 1), {_joined('p', 'char_length(b)')}))[0])[0]"
    whole = f"""concat(b, cast((10 - {luhn_sum("concat(b, '0')")} % 10) % 10 AS string))"""
    card = f"transform(array({d}), d -> IF({luhn_sum('d')} % 10 <> 0, null, transform(array({inner}), b -> transform(array({whole}), w -> {_refill(m, 'w')})[0])[0]))[0]"
    # Social security number: 898 areas (1 to 899 but 666), 99 groups, 9999 serials.
    area, least = "cast(left(d, 3) AS bigint)", "(cast(substr(d, 4, 2) AS bigint) - 1) * 9999 + cast(right(d, 4) AS bigint) - 1"
    ssn = feistel(f"named_struct('tag', 'ssn', 'l', {area} - IF({area} > 666, 2, 1), 'r', {least}, 'ml', 898L, 'mr', 989901L)", key)
    valid = "concat(lpad(cast(p.l + IF(p.l > 664, 2, 1) AS string), 3, '0'), lpad(cast(p.r div 9999 + 1 AS string), 2, '0'), lpad(cast(p.r % 9999 + 1 AS string), 4, '0'))"
    nine = f"transform(array({d}), d -> IF(left(d, 3) IN ('000', '666') OR left(d, 1) = '9' OR substr(d, 4, 2) = '00' OR right(d, 4) = '0000', null, transform(array({ssn}), p -> transform(array({valid}), w -> {_refill(m, 'w')})[0])[0]))[0]"
    # Phone: those of area and exchange from 200 on are permuted among their like (80000 x 80000), and so are all others (60000 x
    # 60000: areas below 200 of any exchange, then the others' exchanges below 200).
    n10 = "right(d, 10)"
    own, exchange, serial = f"cast(left({n10}, 3) AS bigint)", f"cast(substr({n10}, 4, 3) AS bigint)", f"cast(right({n10}, 4) AS bigint)"
    index = f"(({own} - 200) * 800 + {exchange} - 200) * 10000 + {serial}"
    good = f"transform(array({index}), x -> named_struct('tag', 'phone', 'l', x div 80000, 'r', x % 80000, 'ml', 80000L, 'mr', 80000L))[0]"
    back = "transform(array(p.l * 80000 + p.r), x -> concat(lpad(cast(x div 8000000 + 200 AS string), 3, '0'), lpad(cast(x div 10000 % 800 + 200 AS string), 3, '0'), lpad(cast(x % 10000 AS string), 4, '0')))[0]"
    lead = "left(d, char_length(d) - 10)"
    low = f"IF({own} < 200, cast({n10} AS bigint), 2000000000L + (({own} - 200) * 200 + {exchange}) * 10000 + {serial})"
    others = f"transform(array({low}), x -> named_struct('tag', 'phone-', 'l', x div 60000, 'r', x % 60000, 'ml', 60000L, 'mr', 60000L))[0]"
    low_back = "transform(array(p.l * 60000 + p.r), x -> IF(x < 2000000000L, lpad(cast(x AS string), 10, '0'), concat(lpad(cast((x - 2000000000L) div 2000000 + 200 AS string), 3, '0'), lpad(cast((x - 2000000000L) div 10000 % 200 AS string), 3, '0'), lpad(cast(x % 10000 AS string), 4, '0'))))[0]"
    ten = f"IF(left({n10}, 1) >= '2' AND substr({n10}, 4, 1) >= '2', transform(array({feistel(good, key)}), p -> {back})[0], transform(array({feistel(others, key)}), p -> {low_back})[0])"
    phone = f"transform(array({d}), d -> transform(array(concat({lead}, {ten})), w -> {_refill(m, 'w')})[0])[0]"
    form = f"CASE WHEN {m} LIKE '%/%' THEN 'MM/dd/yyyy' WHEN {m} LIKE '%.%' THEN 'dd.MM.yyyy' ELSE 'yyyy-MM-dd' END"
    iso = f"CASE WHEN {m} LIKE '%/%' THEN concat_ws('-', right({m}, 4), left({m}, 2), substr({m}, 4, 2)) WHEN {m} LIKE '%.%' THEN concat_ws('-', right({m}, 4), substr({m}, 4, 2), left({m}, 2)) ELSE {m} END"
    step = feistel(f"named_struct('tag', 'date', 'l', cast(z.x div {DAY_R} AS bigint), 'r', cast(z.x % {DAY_R} AS bigint), 'ml', {DAY_L}L, 'mr', {DAY_R}L)", key)
    # Cycle walking: 121 of 73170 pairs are no day of the range; from there the permutation is applied again.
    walked = f"aggregate(sequence(1, 8), named_struct('x', n, 'done', false), (z, i) -> IF(z.done, z, transform(array({step}), p -> named_struct('x', p.l * {DAY_R} + p.r, 'done', p.l * {DAY_R} + p.r < {DAYS}))[0])).x"
    date = f"transform(array(try_cast({iso} AS date)), t -> IF(t IS NULL OR t < date'1900-01-01' OR t > date'2099-12-31', null, transform(array(cast(datediff(t, date'1900-01-01') AS bigint)), n -> date_format(date_add(date'1900-01-01', cast({walked} AS int)), {form}))[0]))[0]"
    return f"""CASE WHEN {m} LIKE '%@%' THEN {email} WHEN {m} RLIKE '^AKIA' THEN {aws} WHEN {m} RLIKE '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' THEN {ip}
      WHEN {m} RLIKE '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' THEN {nine} WHEN {m} RLIKE '^([0-9]{{2}}/[0-9]{{2}}/|[0-9]{{2}}[.][0-9]{{2}}[.])[0-9]{{4}}$|^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' THEN {date}
      WHEN {m} RLIKE '^[0-9]{{13,19}}$|^[0-9]{{4}}[ -][0-9]+[ -][0-9]+([ -][0-9]+)?$' AND {m} NOT LIKE '% ___ ____' THEN {card}
      WHEN {m} RLIKE '^[0-9a-zA-Z]+$' THEN {other} ELSE {phone} END"""


def redacted(text: str = "text", key: str = KEY) -> F.Column:
    """The text with every validated find replaced; number of those beside it: struct (text, finds)."""
    t = f"`{text}`"
    # Finds and the text between them alternate.
    return F.expr(f"""
    CASE WHEN {t} RLIKE {_q(HINT)} THEN
      transform(array(named_struct('m', regexp_extract_all({t}, {_q(FINDS)}, 0), 's', split({t}, {_q(FINDS)}, -1))), z ->
        IF(coalesce(size(z.m), 0) <= 0, named_struct('text', {t}, 'finds', 0),
          transform(array(transform(z.m, m -> {pseudonym('m', key)})), p ->
            named_struct('text', concat(z.s[0], array_join(transform(z.m, (m, i) -> concat(coalesce(p[i], m), z.s[i + 1])), '')), 'finds', size(filter(p, x -> x IS NOT NULL))))[0]))[0]
    ELSE named_struct('text', {t}, 'finds', 0) END""")


def pseudonymise(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """docs with their texts pseudonymised; all other columns as they are."""
    return docs.select(*[redacted(text, key)["text"].alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_finds, the pseudonymised text."""
    return docs.select("doc_id", redacted("text").alias("p")).select("doc_id", F.col("p.finds").cast("long").alias("n_finds"), "p.text")
