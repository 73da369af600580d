"""Column expressions over labels, guide texts and questions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Segment synonyms, clade prefixes that stand for themselves, words that carry no question, words that
#: stand for others in a question, words that a question of claims has, and topics by the words that tell them.
SEGMENTS = {"HA": ["4", "HA", "SEG4", "4_HA", "HEMAGGLUTININ"], "NA": ["6", "NA", "SEG6", "6_NA", "NEURAMINIDASE"]}
MAJOR = ["6B.1A", "3C.2a1b"]
STOP_WORDS = [
    "a", "al", "and", "are", "como", "con", "de", "del", "does", "el", "en", "es", "este", "for", "is", "it", "la", "las", "lo", "los",
    "me", "mean", "para", "por", "que", "se", "the", "this", "to", "un", "una", "what", "why", "y",
]
ALIASES = {
    "ai": ["guide", "antigenlm", "learned", "model"],
    "antigenlm": ["antigenlm", "latent", "embedding", "learned"],
    "bpe": ["bpe", "tokenizer", "future"],
    "cpg": ["cpg", "observed", "expected", "dinucleotide"],
    "gc": ["gc", "composition", "sequence"],
    "grover": ["grover", "tokenizer", "future"],
    "js": ["jensen", "shannon", "distance", "token"],
    "pca": ["pca", "projection", "representation", "coordinate"],
    "rscu": ["rscu", "codon", "cds"],
    "sne": ["tsne", "projection", "neighborhood", "latent"],
    "structure": ["structure", "pdb", "rcsb", "mapping", "residue"],
    "tsne": ["tsne", "t", "sne", "projection", "neighborhood", "latent"],
    "t-sne": ["tsne", "projection", "neighborhood", "latent"],
    "upa": ["upa", "ta", "observed", "expected"],
}
CLAIMS = [
    "antigenic", "antigenicity", "escape", "fitness", "pathogenicity", "pathogenic", "transmissibility", "vaccine", "vacuna", "virulence",
    "predict", "prediction", "predecir", "causal", "causality", "optimize", "optimizar",
]
TOPICS = {
    "dataset": ["dataset", "panel", "metadata", "atlas", "country", "coverage"],
    "sequence_context": ["gc", "cpg", "upa", "dinucleotide", "k-mer", "sequence-context"],
    "cds": ["cds", "codon", "rscu", "translation", "frame", "rescue"],
    "tokenization": ["token", "tokenizer", "entropy", "vocab", "jaccard", "bootstrap"],
    "representation": ["representation", "pca", "umap", "projector", "centroid", "silhouette"],
    "antigenlm": ["antigenlm", "latent", "embedding", "learned"],
    "structure": ["structure", "pdb", "rcsb", "alignment", "residue", "3lzg", "3vun", "3nss", "6br6"],
    "governance": ["governance", "safe", "hash", "raw sequence", "fasta", "restricted"],
    "claims": ["claim", "predict", "vaccine", "escape", "fitness", "pathogenicity", "limitation"],
    "future": ["grover", "bpe", "phase", "future", "recommendation"],
}
#: Letters with marks and the letters without, by Unicode's own decomposition.
_MARKED = {c: d[0] for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if len(d := unicodedata.normalize("NFD", c)) > 1 and all(unicodedata.combining(m) for m in d[1:])}


def folded(text: Column) -> Column:
    """Lower case without diacritics, precomposed or combining."""
    bare = F.translate(text, "".join(_MARKED), "".join(_MARKED.values()))
    return F.lower(F.regexp_replace(bare, "[\u0300-\u036f]", ""))


def subtype(label: Column) -> Column:
    """The first H<n>N<n>, upper case; else the trimmed label in upper case; else UNKNOWN."""
    found = F.upper(F.regexp_extract(label, "(?i)(H[0-9]+N[0-9]+)", 1))
    bare = F.upper(F.trim(label))
    return F.when(found != "", found).when(bare != "", bare).otherwise(F.lit("UNKNOWN"))


def segment(label: Column) -> Column:
    """A segment's name from its synonyms, else the label in upper case; UNKNOWN for none."""
    bare = F.coalesce(F.nullif(F.upper(F.trim(label)), F.lit("")), F.lit("UNKNOWN"))
    out = F
    for name, known in SEGMENTS.items():
        out = out.when(bare.isin(known), F.lit(name))
    return out.otherwise(bare)


def segment_in(text: Column) -> Column:
    """A segment named by its short name as a word, or by its full name anywhere in a text; else null."""
    return F.when(text.rlike("(?i)hemagglutinin|\\bha\\b"), F.lit("HA")).when(text.rlike("(?i)neuraminidase|\\bna\\b"), F.lit("NA"))


def subtype_in(text: Column) -> Column:
    return F.upper(F.nullif(F.regexp_extract(text, "(?i)(H[0-9]+N[0-9]+)", 1), F.lit("")))


def location_parts(location: Column) -> Column:
    """The non-blank parts between slashes, trimmed."""
    return F.filter(F.transform(F.split(location, "/"), lambda x: F.trim(x)), lambda x: x != "")


def major_clade(clade: Column) -> Column:
    """Named prefixes stand for their clades; else the first two dotted parts; null for no label."""
    bare = F.trim(clade)
    out = F.when(clade.isNull() | F.lower(bare).isin("", "nan", "none"), F.lit(None))
    out = out.when(F.lower(bare) == "unassigned", F.lit("unassigned"))
    for prefix in MAJOR:
        out = out.when(bare.startswith(prefix), F.lit(prefix))
    return out.otherwise(F.substring_index(bare, ".", 2))


def leading_year(date: Column) -> Column:
    return F.nullif(F.regexp_extract(date, "^([0-9]{4})", 1), F.lit("")).cast("int")


def has_clade(label: Column) -> Column:
    """Whether a clade label is more than a mark of nothing; \"unknown\" and the like are labels."""
    return F.coalesce(~F.lower(label).isin("", "nan", "missing"), F.lit(False))


def has_country(label: Column) -> Column:
    """Whether a trimmed country label names one; \"missing\" would be a name."""
    return F.coalesce(~F.lower(F.trim(label)).isin("", "nan", "none", "unknown"), F.lit(False))


def guide_text(markdown: Column) -> Column:
    """Guide prose: long symbol runs redacted, fenced code dropped, white space collapsed."""
    bare = F.regexp_replace(markdown, "[ACGTN]{80,}", "[sequence]")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "(?s)```.*?```", " "), "\\s+", " "))


def topics(*texts: Column) -> Column:
    """Topics one of whose words the texts (title, text, source) hold; ``project`` if none."""
    return F.udf(_topics, "array<string>", useArrow=True)(F.lower(F.concat_ws(" ", *(F.coalesce(t, F.lit("")) for t in texts))))


def _topics(low: str) -> list[str]:
    """In Python, whose search for a word in a text takes a tenth of the time."""
    return [name for name, words in TOPICS.items() if any(w in low for w in words)] or ["project"]


def sections(markdown: Column, least: int = 80, most: int = 8, size: int = 950) -> Column:
    """The first sections between headings, at least ``least`` long, cut to ``size``."""
    parts = F.transform(F.split(markdown, "(?m)^\\s*#+"), lambda x: F.trim(x))
    return F.transform(F.slice(F.filter(parts, lambda x: F.length(x) >= least), 1, most), lambda x: F.left(x, F.lit(size)))


#: What folding can make part of a word: plain letters and digits, marks and marked letters.
WORD = re.compile("[A-Za-z0-9\u0300-\u036F\u00C0-\u024F\u1E00-\u1EFF\u212A]+")
_BARE = str.maketrans(_MARKED | dict.fromkeys(map(chr, range(0x300, 0x370)), ""))


def terms(question: Column) -> Column:
    """Distinct folded words of two letters or more that carry the question.

    A text is split before it is folded, and only its distinct words with other than plain letters are looked up letter by letter.
    In Python, whose patterns take a tenth of the time over long texts.
    """
    return F.udf(_terms, "array<string>", useArrow=True)(question)


def _terms(text: str | None) -> list[str] | None:
    if text is None:
        return None
    told: dict[str, None] = {}
    for w in dict.fromkeys(WORD.findall(text)):
        told.update(dict.fromkeys([w.lower()] if w.isascii() else re.split("[^a-z0-9]+", w.translate(_BARE).lower())))
    return [w for w in told if len(w) > 1 and w not in STOP_WORDS]


def mentions(text: Column, banned: list[str] = CLAIMS) -> Column:
    """Whether a folded text holds one of the words, in any place."""
    low = folded(text)
    return F.exists(F.array(*map(F.lit, banned)), lambda w: F.contains(low, w))


def first_sentence(text: Column) -> Column:
    """The first 80 to 360 characters that end a sentence, else the first 360, white space collapsed."""
    bare = F.trim(F.regexp_replace(text, "\\s+", " "))
    return F.trim(F.coalesce(F.nullif(F.regexp_extract(bare, "^(.{80,360}?[.!?])\\s", 1), F.lit("")), F.left(bare, F.lit(360))))
