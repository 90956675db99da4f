"""Line-notation tokens as columns: reading, encoding, padding, classes, composition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token pattern, the special tokens and the default vocabulary.
TOKEN_PATTERN = r"\[[^\]]+\]|Br?|Cl?|[BCNOPSFIbcnops]|\(|\)|=|#|-|\\|/|%[0-9]{2}|[0-9]|@@?|\+"
SPECIALS = ["<PAD>", "<BOS>", "<EOS>", "<MASK>", "<UNK>"]
ATOMS = ["C", "N", "O", "S", "P", "F", "Cl", "Br", "I", "B"]
AROMATIC = ["c", "n", "o", "s", "p", "b"]
BONDS = ["=", "#", "-"]
STEREO = ["/", "\\"]
STRUCTURE = ["(", ")", "@", "@@", "+"]
RINGS = [str(i) for i in range(10)] + [f"%{i}" for i in range(10, 16)]
BRACKETED = (
    "[NH] [NH2] [NH3+] [NH+] [NH2+] [N+] [N-] [N@@+] [N@+] [nH] [nH+] "
    "[O-] [OH] [OH+] [OH2+] [O+] [S-] [S+] [SH] [S@] [S@@] [sH] "
    "[C@H] [C@@H] [C@] [C@@] [CH] [CH2] [CH3] [C] [cH] [P@] [P@@] [PH] [P+] [P-] "
    "[Cl] [F] [Br] [I] [B-] [BH] [B]"
).split()
PROTEIN_SPECIALS = ["<PAD>", "<BOS>", "<EOS>", "<UNK>", "<MASK>"]
AMINO_ACIDS = list("ACDEFGHIKLMNPQRSTVWY")
THREE_TO_ONE = dict(zip("ALA CYS ASP GLU PHE GLY HIS ILE LYS LEU MET ASN PRO GLN ARG SER THR VAL TRP TYR".split(), AMINO_ACIDS))


def default_vocabulary() -> list[str]:
    return SPECIALS + sorted({*ATOMS, *AROMATIC, *BONDS, *STEREO, *STRUCTURE, *RINGS, *BRACKETED})


def protein_vocabulary() -> list[str]:
    return PROTEIN_SPECIALS + AMINO_ACIDS


def lookup(pairs: dict) -> Column:
    """A literal map; for vocabularies and code tables, whose size is fixed."""
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def tokens(text: Column) -> Column:
    """Tokens in order; a bracket atom is one token, characters that begin no token are skipped."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def is_tokenizable(text: Column) -> Column:
    return F.size(tokens(text)) > 0


def encode(toks: Column, vocabulary: list[str], unknown: str = "drop", ends: bool = True) -> Column:
    """Ids of tokens between BOS and EOS. ``unknown``: "drop" makes the whole sequence null if a token isn't in the
    vocabulary, "unk" puts UNK there."""
    ids = lookup({t: i for i, t in enumerate(vocabulary)})
    unk = vocabulary.index("<UNK>")
    known = F.transform(toks, lambda t: F.coalesce(F.try_element_at(ids, t), F.lit(unk if unknown == "unk" else -1)))
    body = F.concat(F.array(F.lit(vocabulary.index("<BOS>"))), known, F.array(F.lit(vocabulary.index("<EOS>")))) if ends else known
    return body if unknown == "unk" else F.when(~F.array_contains(known, -1), body)


def decode(ids: Column, vocabulary: list[str], specials: int = 5) -> Column:
    """Tokens of ids, specials and unknown ids left out, as one string."""
    names = lookup(dict(enumerate(vocabulary)))
    return F.array_join(F.filter(F.transform(ids, lambda i: F.when(i >= specials, F.try_element_at(names, i))), lambda t: t.isNotNull()), "")


def pad_to(ids: Column, n: int, pad: int = 0) -> Column:
    """Padded or cut to ``n``; a cut may take the EOS."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), n)), 1, n)


def attention_mask(ids: Column, pad: int = 0) -> Column:
    return F.transform(ids, lambda x: (x != pad).cast("int"))


def encode_protein(text: Column, max_length: int | None = None, ends: bool = True) -> Column:
    """Upper case, trimmed, a letter an id, others UNK; with ends, a cut keeps the EOS."""
    vocabulary = protein_vocabulary()
    ids = lookup({t: i for i, t in enumerate(vocabulary)})
    unk, bos, eos = vocabulary.index("<UNK>"), vocabulary.index("<BOS>"), vocabulary.index("<EOS>")
    clean = F.trim(F.upper(text))
    letters = F.filter(F.split(clean, ""), lambda x: x != "")
    body = F.transform(letters, lambda x: F.coalesce(F.try_element_at(ids, x), F.lit(unk)))
    if not ends:
        return body if max_length is None else F.slice(body, 1, max_length)
    if max_length is not None:
        body = F.when(F.size(body) + 2 > max_length, F.slice(body, 1, max(0, max_length - 2))).otherwise(body)
    return F.concat(F.array(F.lit(bos)), body, F.array(F.lit(eos)))


def decode_protein(ids: Column) -> Column:
    return decode(ids, protein_vocabulary())


def token_class(token: Column) -> Column:
    """Class of one token by the grammar's table; "other" for what has none."""
    return (
        F.when(token.isin(SPECIALS), "special")
        .when(token.startswith("[") & token.endswith("]") & (F.length(token) > 2), "bracket_atom")
        .when(token.isin(ATOMS), "atom")
        .when(token.isin(AROMATIC), "aromatic_atom")
        .when(token.isin(BONDS), "bond")
        .when(token.isin(STEREO), "stereo")
        .when(token.rlike("^([0-9]|%[0-9]{2,})$"), "ring_digit")
        .when(token == "(", "paren_open")
        .when(token == ")", "paren_close")
        .otherwise("other")
    )


def is_atom_class(cls: Column) -> Column:
    """Atoms of all kinds: plain, aromatic and bracketed."""
    return cls.isin("atom", "aromatic_atom", "bracket_atom")


ELEMENT_PATTERN = r"^\[?\d*(se|as|[A-Z][a-z]?|[bcnops])"
CHARGE_PATTERN = r"([+-]+)(\d*)(?::\d+)?\]$"


def elements(text: Column) -> Column:
    """Element of each atom token, aromatic ones capitalised; explicit hydrogens left out."""
    return _elements(tokens(text))


def _elements(toks: Column) -> Column:
    raw = F.transform(F.filter(toks, lambda t: t.rlike(r"^(\[|[A-Za-z])")), lambda t: F.regexp_extract(t, ELEMENT_PATTERN, 1))
    return F.filter(F.transform(raw, lambda e: F.concat(F.upper(F.substring(e, 1, 1)), F.substring(e, 2, 1))), lambda e: e != "H")


def charges(text: Column) -> Column:
    """Formal charge of each bracket atom that has one."""
    return _charges(tokens(text))


def _charges(toks: Column) -> Column:
    charged = F.filter(toks, lambda t: t.rlike(r"^\[") & t.rlike(CHARGE_PATTERN))

    def of(t: Column) -> Column:
        sign, digits = F.regexp_extract(t, CHARGE_PATTERN, 1), F.regexp_extract(t, CHARGE_PATTERN, 2)
        size = F.when(digits == "", F.length(sign)).otherwise(F.try_to_number(digits, F.lit("99")).cast("int"))
        return F.when(sign.startswith("-"), -size).otherwise(size)

    return F.transform(charged, of)


def composition(text: Column) -> Column:
    """Counts that need no toolkit: atoms, elements, charge, charged atoms, fragments, ring bonds, bonds, hetero atoms."""

    def read(toks: Column) -> Column:
        rings = F.size(F.filter(toks, lambda t: t.rlike("^([0-9]|%[0-9]{2})$")))
        return F.struct(_elements(toks).alias("elements"), _charges(toks).alias("charges"), F.floor(rings / 2).cast("int").alias("ring_bonds"))

    def count(x: Column) -> Column:
        fragments = F.size(F.filter(F.split(text, r"\."), lambda f: f != ""))
        n = F.size(x["elements"])
        return F.struct(
            n.alias("atoms"),
            x["elements"].alias("elements"),
            F.aggregate(x["charges"], F.lit(0), lambda a, c: a + c).alias("charge"),
            F.size(F.filter(x["charges"], lambda c: c != 0)).alias("charged_atoms"),
            fragments.alias("fragments"),
            x["ring_bonds"].alias("ring_bonds"),
            (n - fragments + x["ring_bonds"]).alias("bonds"),
            F.size(F.filter(x["elements"], lambda e: e != "C")).alias("hetero_atoms"),
        )

    return once(once(tokens(text), read), count)


def one_letter(residue: Column, unknown: str | None = "X") -> Column:
    """One-letter residue code; ``unknown`` stands for others, None leaves null."""
    code = F.try_element_at(lookup(THREE_TO_ONE), F.trim(residue))
    return code if unknown is None else F.coalesce(code, F.lit(unknown))
