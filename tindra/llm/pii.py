"""Personal data: detected entities get keyed surrogates of the same type and form.

All of it is DataFrame functions.  One pattern finds the entities of a text in order; the text is split
by the same pattern, and gaps and surrogates are joined again.  The pattern leaves out what a text has
no sign of (an ``@``, a digit), and its branches start with the characters they can start with.

An entity is one unit or, for names, a unit per word: ``Mr. John Smith``, ``John Smith`` and ``Mr.
Smith`` share the units John and Smith, so a person keeps one surrogate in all forms.  A unit's
surrogate comes from a keyed, invertible substitution.  Every character moves within its class (vowels,
consonants and accented letters of Latin, vowels and consonants of Cyrillic and Greek script, letters
of Arabic, Hebrew and the Kana, in either case where there is one; digits) by a shift that hangs on the
key, the kind and the characters before it; a second pass from the end spreads the last characters to
the first and always moves the first one, so no unit is its own surrogate.  Characters in no class -
separators, marks - stay, so script, case, length and format stay too, and within a format different
units get different surrogates.  A name with letters of other scripts takes a keyed Latin word.

Kinds add what their form asks for: titles stay before a name and a name's gender-bearing last letter
stays; listed given names are drawn from other names of their gender, which are not in the lists that
detect; network addresses move each part within its range; card numbers keep their first digit, and
cards and bank accounts whether their check digits are right; telephone numbers keep the country code;
mail addresses keep the top-level domain, and mails of one domain share its surrogate.

The result is checked over the distinct units of the corpus: a surrogate must be no real unit, and no
two units may share one.  Units that fail take the key's next versions, round by round; only those few
are looked up when texts are rewritten.  Where a form is full - its values are all real, as with short
telephone numbers in a large corpus - surrogates leave the form and grow: names and mail addresses by an
ending, numbers by further digits after a blank, network addresses after a stop.

Names are found by a title before them, by a listed given name, or by a word that names follow (CUES),
with all capitalised words and initials that go on; a name that none of these marks is not found.  A mail
host has at most 127 labels, as hosts have.  The same unit always gets the same surrogate, so coreference
is kept within and across documents.

Semantics: null text stays null, empty stays empty; every row and column is kept; repeated rows and
ids do not matter; an empty table gives no rows; columns named like the results are overwritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tindra.llm import shared

# Letter classes and name lists.
CLASSES = (
    "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "0123456789",
    "áàâäãåéèêëíìîïóòôöõøúùûüýæœ", "ÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕØÚÙÛÜÝÆŒ", "çñßðþłšžčřćśźńğş", "ÇÑÐÞŁŠŽČŘĆŚŹŃĞŞ",
    "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ",
    "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
    "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "אבגדהוזחטיכלמנסעפצקרשת",
    "かきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろ", "カキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロ",
)
MALE = "James John Robert Michael William David Thomas Charles Hans Peter Klaus Jürgen Jean Pierre Michel André José Antonio Manuel Carlos Richard Joseph Daniel Matthew Anthony Steven Paul Andrew Wolfgang Stefan Uwe Bernd Philippe Alain Nicolas Francisco Javier Miguel Luis Juan".split()
FEMALE = "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Sarah Ursula Monika Petra Sabine Marie Jeanne Nathalie Isabelle María Carmen Josefa Ana Jessica Karen Nancy Margaret Sandra Ashley Emily Donna Renate Ingrid Heike Claudia Sylvie Catherine Monique Christine Isabel Dolores Pilar Teresa".split()
NEW_MALE = "Gregory Kenneth Ronald Raymond Douglas Lawrence Vincent Harold Dieter Günther Manfred Helmut Torsten Heinz Olivier Thierry Laurent Didier Sébastien Gilles Rafael Ramón Enrique Alfonso Sergio Andrés Esteban Gonzalo Stanley Leonard Howard Clifford Norbert Ulrich Matthias Rainer Cédric Arnaud Emilio Ignacio".split()
NEW_FEMALE = "Deborah Cynthia Angela Brenda Pamela Virginia Theresa Marilyn Gisela Helga Brigitte Gudrun Martina Silke Véronique Valérie Martine Delphine Aurélie Brigida Rosario Mercedes Concepción Beatriz Lucía Inés Consuelo Esperanza Gladys Doris Judith Evelyn Annegret Waltraud Hannelore Edeltraud Mireille Solange Remedios Amparo".split()
TITLES = "Mr|Mrs|Ms|Miss|Dr|Herr|Frau|Señora|Señor|Sra|Sr|Monsieur|Madame|Mme|Mlle"
ENDINGS = "in on an el ar os et ik ur om".split()  # a name out of room is longer by one of these

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_NAME = "\\p{Lu}[\\p{L}'’]++"
_MORE = f"(?:[ -](?:{_NAME}|\\p{{Lu}}\\.))*+"  # further words and initials, however many
PATTERNS = {
    "email": "(?<![\\p{L}0-9._%+-])[\\p{L}0-9._%+-]++@[\\p{L}0-9-]{1,63}(?:\\.[\\p{L}0-9-]{1,63}){0,126}\\.\\p{L}{2,24}(?![\\p{L}0-9])",
    "ip": f"(?<![0-9.])(?:{_OCTET}\\.){{3}}{_OCTET}(?![0-9]|\\.[0-9])",
    "card": "(?<![0-9])(?:[3-6][0-9]{3}[ -]?(?:[0-9]{4}[ -]?){2}[0-9]{4}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9])",
    "ssn": "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": "(?<![0-9+])(?:\\+[0-9]{1,3}[ -]?(?:\\([0-9]{1,4}\\)[ -]?)?[0-9]{2,4}(?:[ -]?[0-9]{2,4}){1,4}|\\([0-9]{3}\\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})(?![0-9])",
    "iban": "(?<![\\p{L}0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\\p{L}0-9])",
    "title": f"(?<!\\p{{L}})(?:{TITLES})\\.? (?:\\p{{Lu}}\\. ?)*+{_NAME}{_MORE}",
    "given": f"(?<!\\p{{L}})(?:{'|'.join(MALE + FEMALE)})(?!\\p{{L}}){_MORE}",
}
_branch = lambda first, *kinds: f"(?={first})(?:{'|'.join(PATTERNS[k] for k in kinds)})"
# Words that a name follows; the name alone is the entity, of the kind 'person'.
CUES = "[Mm]y name is|I am called|[Nn]ame:|[Cc]ontact:|[Aa]uthor:|[Ss]igned:|[Ss]igned by|[Ww]ritten by|[Dd]ear|[Mm]ein Name ist|[Ii]ch heiße|[Ll]iebe|[Ll]ieber|[Jj]e m'appelle|[Cc]her|[Cc]hère|[Mm]e llamo|[Mm]i nombre es|[Nn]ombre:|[Nn]om :|[Ee]stimado|[Ee]stimada"
CUED = f"(?<!\\p{{L}})(?<=(?<!\\p{{L}})(?:{CUES}) )(?!(?:{TITLES})(?!\\p{{L}}))(?:\\p{{Lu}}\\. ?)*+{_NAME}{_MORE}"
NAMES = f"(?:(?<!\\p{{L}}){_branch('[A-Z]', 'title', 'given')}|(?=\\p{{Lu}}){CUED})"
NUMBERS = f"{_branch('[0-9+(]', 'ip', 'card', 'ssn', 'phone')}|{_branch('[A-Z]', 'iban')}"
ANY = f"{PATTERNS['email']}|{NUMBERS}|{NAMES}"
ROOMLESS = 6  # from this version on surrogates leave their form and grow by a sign a version

_WORD = "[\\p{L}'’]"
_KNOWN = "".join(CLASSES)
_DIGITS_LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array(values: list[str]) -> str:
    return "array(" + ", ".join(map(quoted, values)) + ")"


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to a value (a one-element transform binds it)."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


# In what follows ``key`` is an SQL string expression.


def _draw(key: str, kind: str, prefix: str) -> str:
    """SQL: a number from 0 to 2**32 - 1 that hangs on key, kind and prefix."""
    return f"cast(conv(substring(sha2(concat({key}, {quoted('|' + kind + '|')}, {prefix}), 256), 1, 8), 16, 10) as bigint)"


def _pass(s: str, key: str, kind: str, own: str) -> str:
    """SQL: one substitution pass over the string expression ``s``; ``own`` is what happens to the
    character at the place ``f``: 'stays' or 'moves' (by one step at least)."""
    char = "substring(w, i, 1)"
    draw = _draw(key, kind, "substring(w, 1, i - 1)")
    step = f"if(i = f, 0, {draw})" if own == "stays" else f"if(i = f, 1 + pmod({draw}, length(a) - 1), {draw})"
    moved = f"coalesce(get(transform(filter({_array(list(CLASSES))}, a -> instr(a, {char}) > 0), a -> substring(a, cast(1 + pmod(instr(a, {char}) - 1 + {step}, length(a)) as int), 1)), 0), {char})"
    return _let(s, "w", f"if(length(w) = 0, '', array_join(transform(sequence(1, length(w)), i -> {moved}), ''))")


def scramble(s: str, key: str, kind: str) -> str:
    """SQL: the two-pass substitution of a string expression; its first character with a class moves."""
    first = f"1 + length(regexp_extract(x, {quoted(f'^[^{_KNOWN}]*')}, 0))"
    back = _let("1 + length(x) - f", "f", _pass("reverse(y)", key, kind + "<", "moves"))
    return _let(s, "x", _let(first, "f", f"reverse({_let(_pass('x', key, kind, 'stays'), 'y', back)})"))


def _luhn(head: str) -> str:
    """SQL: the check digit of the digits before it."""
    digit = "cast(substring(h, i, 1) as int)"
    twice = f"if(pmod(length(h) - i, 2) = 0, {digit} * 2 - if({digit} > 4, 9, 0), {digit})"
    return _let(head, "h", f"pmod(10 - pmod(aggregate(sequence(1, length(h)), 0, (t, i) -> t + {twice}), 10), 10)")


def _account_check(country: str, rest: str) -> str:
    """SQL: the right two check digits of a bank account, as a number from 2 to 98."""
    value = f"(instr('{_DIGITS_LETTERS}', c) - 1)"
    return f"98 - aggregate(split(concat(regexp_replace({rest}, ' ', ''), {country}, '00'), ''), 0, (t, c) -> cast(pmod(t * if({value} > 9, 100, 10) + {value}, 97) as int))"


def _grown(version: str, one) -> str:
    """SQL: what a surrogate of a version has beyond its form; ``one`` gives the SQL of a step's sign."""
    return f"if({version} < {ROOMLESS}, '', array_join(transform(sequence({ROOMLESS}, greatest({version}, {ROOMLESS})), g -> {one('g')}), ''))"


def _name(p: str, key: str, version: str) -> str:
    """SQL: all but the last letter moved; a Latin word for letters of no class."""
    other = f"{p} rlike {quoted(f'[^{_KNOWN}' + chr(39) + '’]')}"
    letters = f"initcap(translate(substring(sha2(concat({key}, '|other|', {p}), 256), 1, 10), '0123456789abcdef', 'bakedilomuneraso'))"
    more = _grown(version, lambda g: f"element_at({_array(ENDINGS)}, cast(1 + pmod({_draw(key, 'more', f'concat({p}, cast({g} as string))')}, {len(ENDINGS)}) as int))")
    return f"if({other}, {letters}, concat({scramble(f'left({p}, greatest(length({p}) - 1, 1))', key, 'name')}, if(length({p}) > 1, right({p}, 1), ''), {more}))"


def _listed(p: str, names: list[str], new: list[str], key: str, kind: str, version: str) -> str:
    """SQL: a given name's place taken by one of other names of its gender, in keyed rotation."""
    at = f"cast(1 + pmod(array_position({_array(names)}, {p}) - 1 + {_draw(key, kind, quoted(''))}, {len(new)}) as int)"
    return f"if({version} < {ROOMLESS}, element_at({_array(new)}, {at}), {_name(p, key, version)})"


def kind(m: str) -> str:
    """SQL: the kind of an entity."""
    return "case " + " ".join(f"when {m} rlike {quoted('^(?:' + p + ')$')} then '{k}'" for k, p in PATTERNS.items()) + " else 'person' end"


def _unit_of_word(p: str) -> str:
    return f"concat(case when array_contains({_array(MALE)}, {p}) then 'male' when array_contains({_array(FEMALE)}, {p}) then 'female' else 'name' end, '|', {p})"


def _pieces(m: str) -> str:
    """SQL: the words of a name and what stands between them."""
    return f"regexp_extract_all({m}, {quoted(f'({_WORD}+|[^{_WORD[1:-1]}]+)')}, 1)"


def _is_name_word(p: str, i: str) -> str:
    return f"({p} rlike {quoted(f'^{_WORD}')} and not ({i} = 0 and {p} rlike {quoted(f'^(?:{TITLES})$')}))"


def units(m: str) -> str:
    """SQL: the units of an entity, ``kind|text``."""
    words = f"filter(transform({_pieces('m')}, (p, i) -> if({_is_name_word('p', 'i')}, {_unit_of_word('p')}, null)), u -> u is not null)"
    return _let(m, "m", _let(kind("m"), "k", f"if(k in ('title', 'given', 'person'), {words}, array(concat(k, '|', m)))"))


def unit_surrogate(unit: str, key: str, version: str = "0") -> str:
    """SQL: the surrogate of a unit under a key and its version (SQL expressions)."""
    digits = "regexp_replace(m, '[^0-9]', '')"
    head = scramble("substring(m, 2, length(m) - 2)", "key", "card")
    right = "substring(" + digits + f", 1, length({digits}) - 1)"
    card = _let(head, "n", f"concat(left(m, 1), n, cast(pmod({_luhn(f'concat(left(m, 1), regexp_replace(n, {quoted("[^0-9]")}, {quoted("")}))')} + cast(right({digits}, 1) as int) - {_luhn(right)}, 10) as string))")
    low = "cast(get(split(m, '\\\\.'), i) as int)"
    before = "array_join(slice(split(m, '\\\\.'), 1, i), '.')"
    ip = f"array_join(transform(array(0, 1, 2, 3), i -> cast(if(i = 0 and {low} between 1 and 223, 1 + pmod({low} - 1 + {_draw('key', 'ip', before)}, 223), if(i = 0, {low}, pmod({low} + {_draw('key', 'ip', before)}, 256))) as string)), '.')"
    cut = "length(regexp_extract(m, '^(\\\\+[0-9]{1,3}[ (-]|\\\\+[0-9]|)', 1))"
    phone = _let(cut, "n", f"concat(left(m, n), {scramble('substring(m, n + 1)', 'key', 'phone')})")
    tld = "regexp_extract(m, '(\\\\.[^.@]+)$', 1)"
    email = f"concat({scramble('left(m, instr(m, ' + quoted('@') + ') - 1)', 'key', 'mail')}, '@', {scramble('substring(m, instr(m, ' + quoted('@') + f') + 1, length(m) - instr(m, ' + quoted('@') + f') - length({tld}))', 'key', 'domain')}, {tld})"
    off = f"cast(substring(m, 3, 2) as int) - ({_account_check('left(m, 2)', 'substring(m, 5)')})"
    iban = _let(scramble("substring(m, 5)", "key", "iban"), "n", f"concat(left(m, 2), lpad(cast(2 + pmod({_account_check('left(m, 2)', 'n')} - 2 + {off}, 97) as string), 2, '0'), n)")
    digit = _grown("v", lambda g: f"cast(pmod({_draw('key', 'more', f'concat(m, cast({g} as string))')}, 10) as string)")
    tail = f"if(v < {ROOMLESS}, '', concat(case k when 'ip' then '.' when 'email' then '' else ' ' end, {digit}))"
    mail_tail = _grown("v", lambda g: f"element_at({_array(ENDINGS)}, cast(1 + pmod({_draw('key', 'more', f'concat(m, cast({g} as string))')}, {len(ENDINGS)}) as int))")
    email = f"concat({mail_tail}, {email})"
    made = f"case k when 'email' then {email} when 'ip' then {ip} when 'card' then {card} when 'phone' then {phone} when 'iban' then {iban} when 'male' then {_listed('m', MALE, NEW_MALE, 'key', 'male', 'v')} when 'female' then {_listed('m', FEMALE, NEW_FEMALE, 'key', 'female', 'v')} when 'name' then {_name('m', 'key', 'v')} else {scramble('m', 'key', 'number')} end"
    made = f"concat({made}, if(k in ('email', 'male', 'female', 'name'), '', {tail}))"
    bound = _let(f"concat({key}, '#', cast(v as string))", "key", _let("substring_index(u, '|', 1)", "k", _let("substring(u, length(k) + 2)", "m", made)))
    return _let(unit, "u", _let(version, "v", bound))


def surrogate(m: str, key: str, version=lambda unit: "0") -> str:
    """SQL: the surrogate of an entity; ``version`` gives the SQL of a unit's version."""
    own = lambda unit: unit_surrogate(unit, key, version(unit))
    name = f"array_join(transform({_pieces('e')}, (p, i) -> if({_is_name_word('p', 'i')}, {own(_unit_of_word('p'))}, p)), '')"
    return _let(m, "e", _let(kind("e"), "c", f"if(c in ('title', 'given', 'person'), {name}, {own(f'concat(c, {quoted("|")}, e)')})"))


def _chosen(text: Column, use) -> Column:
    """``use`` of the pattern of the kinds that the text may hold."""
    email = PATTERNS["email"]
    mail, digit = F.instr(text, "@") > 0, text.rlike("[0-9]")
    return F.when(mail & digit, use(ANY)).when(mail, use(f"{email}|{NAMES}")).when(digit, use(f"{NUMBERS}|{NAMES}")).otherwise(use(NAMES))


def found(text: Column) -> Column:
    """The entities of a text in order; null for a null text."""
    return _chosen(text, lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0)))


def versions(unit_table: DataFrame, key: str, name: str = "pii") -> DataFrame | None:
    """unit and version (over 0) of the units whose first surrogate is a real unit or another's; None
    where there are none.  ``unit_table`` has distinct units (column unit).

    Rounds: all open units propose the surrogate of the next version; one that is neither real nor
    taken goes to the smallest unit that proposes it.  Where a round settles under half of what is open,
    as in a form whose values are all real, the next one is that of longer surrogates: they have ten
    times the room of the version before, so every unit comes to one of its own."""
    real = unit_table.select(F.expr("substring(unit, length(substring_index(unit, '|', 1)) + 2)").alias("s")).distinct()
    waiting, taken, moved, version, open_units = unit_table, real, None, 0, unit_table.count()
    while open_units:
        proposed = waiting.select("unit", F.expr(unit_surrogate("unit", quoted(key), str(version))).alias("s"))
        won = shared.settle(proposed.join(taken, "s", "left_anti").groupBy("s").agg(F.min("unit").alias("unit")), f"{name}-won")
        waiting = shared.settle(waiting.join(won, "unit", "left_anti"), f"{name}-waiting")
        if version:
            here = won.select("unit", F.lit(version).alias("version"))
            moved = here if moved is None else moved.unionByName(here)
        left = waiting.count()
        version = max(version + 1, ROOMLESS) if version and 2 * left > open_units else version + 1
        open_units = left
        taken = taken.unionByName(won.select("s"))
    return moved


def pseudonymise(docs: DataFrame, key: str = "tindra", text_column: str = "text") -> DataFrame:
    """All rows and columns with the text rewritten, and the columns n_entities and entity_kinds."""
    text, own = F.col(text_column), shared.own_prefix(docs)
    hashed, marks, per_text, copies = (f"{own}{x}" for x in ("h", "found", "versions", "n"))
    held = docs.select(F.xxhash64(text).alias(hashed), found(text).alias("e")).where("size(e) > 0")
    held = shared.settle(held.select(hashed, F.expr(f"array_distinct(flatten(transform(e, x -> {units('x')})))").alias("units")), "pii-entities")
    every = shared.settle(held.select(F.explode("units").alias("unit")).distinct(), "pii-units")
    moved = versions(every, key)
    staged = docs
    version = lambda unit: "0"
    if moved is not None:
        by_text = held.select(hashed, F.explode("units").alias("unit")).join(shared.settle(moved, "pii-versions"), "unit")
        by_text = by_text.groupBy(hashed).agg(F.map_from_entries(F.collect_set(F.struct("unit", "version"))).alias(per_text), F.count("*").alias(copies))
        # before the pattern runs, so each row meets it in one branch of the lookup only
        staged = shared.lookup(docs.withColumn(hashed, F.coalesce(F.xxhash64(text), F.lit(0))), shared.settle(by_text, "pii-by-text"), [hashed], copies, held.count())
        version = lambda unit: f"coalesce(element_at({per_text}, {unit}), 0)"
    staged = staged.withColumn(marks, found(text))
    any_found = F.coalesce(F.size(marks) > 0, F.lit(False))
    new = F.expr(f"transform({marks}, m -> {surrogate('m', quoted(key), version)})")
    gaps = _chosen(text, lambda p: F.split(text, p, -1))
    rebuilt = F.array_join(F.flatten(F.zip_with(gaps, F.concat(new, F.array(F.lit(""))), lambda g, s: F.array(g, F.coalesce(s, F.lit(""))))), "")
    kinds = F.array_sort(F.array_distinct(F.expr(f"transform({marks}, m -> {kind('m')})")))
    none = F.array().cast("array<string>")
    out = staged.withColumns({text_column: F.when(any_found, rebuilt).otherwise(text), "n_entities": F.coalesce(F.when(any_found, F.size(marks)), F.lit(0)), "entity_kinds": F.when(any_found, kinds).otherwise(none)})
    return out.drop(hashed, marks, per_text, copies)
