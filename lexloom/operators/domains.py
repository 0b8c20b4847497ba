"""Domain gates and domain candidates (DOM)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.operators import spans

#: Characters of a text that the gates look at.
SNIFF_CHARS = 80_000

# Cues, their patterns and weights.
BIO_STRONG = {
    "rna": (r"\b(?:mRNA|tRNA|rRNA|miRNA|siRNA|sgRNA|gRNA|lncRNA|snRNA|scRNA|cDNA|gDNA)\b", 5),
    "cytokine": (r"\b(?:IL-\d{1,3}|IFN-[α-ω]|TNF-[α-ω]|TGF-[α-ω])\b", 5),
    "virus": (r"\b(?:SARS-CoV-2|MERS-CoV|H[1-9]N[1-9])\b", 5),
}
BIO_SUPPORT = {
    "pcr": (r"(?i)\b(?:PCR|qPCR|RT-?qPCR|CRISPR|Cas9|ELISA|Western blot)\b", 2),
    "units": (r"\b(?:mg/dL|μL|uL|mM|μM|ng/mL|ug/mL|OD ?(?:600|260|280))\b", 1),
    "stats": (r"(?i)\b(?:95%\s*CI|confidence interval|odds ratio|hazard ratio|p\s*<\s*0\.\d+|HR\s*=?\s*\d)\b", 2),
    "sections": (r"\b(?:Abstract|Methods?|Materials and Methods|Results|Discussion)\b", 1),
    "greek": (r"[Ͱ-Ͽ]", 1),
}
BIO_DIRECT = r"\b(?:mRNA|miRNA|sgRNA|SARS-CoV-2|MERS-CoV|H\d{1,2}N\d{1,2}|IL-\d{1,3}|[35][′'\"]-?UTR)\b"
BIO_LEAST = 8
_SUBJECT_SHALL = r"\b(?:The\s+)?(?:Agreement|Services|Party|Parties|Customer|Supplier|Company|Contractor|Client|Licensee|Licensor)\s+shall\s+\w+"
LEGAL_STRONG = {
    "quoted_means": (r'(?i)"[A-Z][^"\n]{1,80}"\s+(?:shall\s+)?means?\b', 6),
    "hereinafter": (r"(?i)\bhereinafter\b", 6),
    "this_agreement": (r"(?i)\bthis\s+Agreement\b", 4),
    "capitalised_term_shall": (_SUBJECT_SHALL, 6),
    "contract_subject_shall": (_SUBJECT_SHALL, 6),
}
LEGAL_SUPPORT = {
    "pursuant": (r"(?i)\bpursuant\s+to\b", 2),
    "schedule": (r"(?i)\b(?:Schedule|Appendix|Exhibit)\s+[A-Z0-9]+\b", 2),
    "clause_section": (r"(?i)\b(?:clause|section)\s+\d+(?:\.\d+)*\b", 1),
    "governing_law": (r"(?i)\bgoverning\s+law\b|\bjurisdiction\b", 2),
    "indemnity_liability": (r"(?i)\bindemnif(?:y|ication)\b|\bliabilit(?:y|ies)\b", 2),
    "force_majeure": (r"(?i)\bforce\s+majeure\b", 3),
    "eu_cite": (r"(?i)\bRegulation\s*\(\s*EU\s*\)\s*\d{3,4}/\d{2,4}\b", 3),
    "act_year": (r"\b[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){0,4}\s+Act\s+\d{4}\b", 2),
    "contract_nouns": (r"(?i)\b(?:agreement|services|party|parties|term|obligation|obligations|commence)\b", 1),
}
LEGAL_LEAST = 6
STRUCTURE_STRONG = {k: (rf"(?i)\b{k}\s+[A-Z0-9]+\b", 4) for k in ("schedule", "appendix", "exhibit", "annex")}
STRUCTURE_SUPPORT = {
    "section": (r"(?i)\bsection\s+\d+(?:\.\d+)*\b", 2),
    "clause": (r"(?i)\bclause\s+\d+(?:\.\d+)*\b", 2),
    "article": (r"(?i)\barticle\s+[A-Z0-9]+\b", 2),
    "part": (r"(?i)\bpart\s+[A-Z0-9]+\b", 2),
    "chapter": (r"(?i)\bchapter\s+\d+(?:\.\d+)*\b", 2),
}
STRUCTURE_LEAST = 4
BIO_CANDIDATE = (
    r"(?:m|t|r|mi|si|sg|g|lnc|sn|sc|pi|sh|nc)RNA|cDNA|gDNA|IL-\d{1,3}|(?:TNF|IFN)-[α-ω]|TGF-[α-ω\d]"
    r"|SARS-CoV-2|MERS-CoV|H\d{1,2}N\d{1,2}|[35]['′″]-?\s?UTR|[A-Z][a-z]+[A-Z0-9][A-Za-z0-9]{1,6}|[A-Z]{2,6}\d{0,2}"
)
LEGAL_CANDIDATE = (
    r"(?:MiFID|CRR|Basel|Solvency|MAR|EMIR)\s+(?:I{1,4}|V|VI|VII|VIII|IX|X)"
    r"|\b(?:Regulation|Directive)\s*(?:\(\s*EU\s*\))?\s*\d{4}/\d{2,4}(?:/EU)?\b"
    r"|\b[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){0,4}\s+Act\s+\d{4}\b|\bISO\s+\d{4,5}\b"
)


def _score(text: Column, cues: dict[str, tuple[str, int]]) -> Column:
    return sum((F.when(text.rlike(p), w).otherwise(0) for p, w in cues.values()), F.lit(0))


def _any(text: Column, cues: dict[str, tuple[str, int]]) -> Column:
    out = F.lit(False)
    for p, _ in cues.values():
        out = out | text.rlike(p)
    return out


def _cues(text: Column, **cues: dict[str, tuple[str, int]]) -> list[Column]:
    """A struct of flags for each set of cues, so that a text is searched for each cue once."""
    return [F.struct(*[text.rlike(p).alias(k) for k, (p, _) in some.items()]).alias(name) for name, some in cues.items()]


def _weighed(name: str, cues: dict[str, tuple[str, int]]) -> Column:
    return sum((F.when(F.col(name)[k], w).otherwise(0) for k, (_, w) in cues.items()), F.lit(0))


def _some(name: str, cues: dict[str, tuple[str, int]]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(name)[k] for k in cues])


def gates(docs: DataFrame) -> DataFrame:
    """DOM-01..04: scores and whether each domain is on, by document."""
    t = F.col("_t")
    found = _cues(t, bio1=BIO_STRONG, bio2=BIO_SUPPORT, legal1=LEGAL_STRONG, legal2=LEGAL_SUPPORT, structure1=STRUCTURE_STRONG, structure2=STRUCTURE_SUPPORT)
    rows = docs.select("doc_id", F.substring("text", 1, SNIFF_CHARS).alias("_t")).select("doc_id", "_t", *found)
    repeated = sum((F.when(F.regexp_count(t, F.lit(STRUCTURE_SUPPORT[k][0])) >= 2, 2).otherwise(0) for k in ("section", "clause")), F.lit(0))
    rows = rows.select(
        "*",
        (_weighed("bio1", BIO_STRONG) + _weighed("bio2", BIO_SUPPORT)).alias("bio_score"),
        (_weighed("legal1", LEGAL_STRONG) + _weighed("legal2", LEGAL_SUPPORT)).alias("legal_score"),
        (_weighed("structure1", STRUCTURE_STRONG) + _weighed("structure2", STRUCTURE_SUPPORT) + repeated).alias("structure_score"),
    )
    return rows.select(
        "doc_id",
        "bio_score",
        (_some("bio1", BIO_STRONG) | (F.col("bio_score") >= BIO_LEAST) | t.rlike(BIO_DIRECT)).alias("bio"),
        "legal_score",
        (_some("legal1", LEGAL_STRONG) | (F.col("legal_score") >= LEGAL_LEAST)).alias("legal"),
        "structure_score",
        (_some("structure1", STRUCTURE_STRONG) | (F.col("structure_score") >= STRUCTURE_LEAST)).alias("structure"),
    )


def is_bio(text: Column) -> Column:
    t = F.substring(text, 1, SNIFF_CHARS)
    return _any(t, BIO_STRONG) | (_score(t, BIO_STRONG) + _score(t, BIO_SUPPORT) >= BIO_LEAST) | t.rlike(BIO_DIRECT)


def is_legal(text: Column) -> Column:
    t = F.substring(text, 1, SNIFF_CHARS)
    return _any(t, LEGAL_STRONG) | (_score(t, LEGAL_STRONG) + _score(t, LEGAL_SUPPORT) >= LEGAL_LEAST)


def candidates(docs: DataFrame, keep: list[str] | None = None, **around) -> DataFrame:
    """DOM-05, DOM-06: spans that a domain adds where it is on, with contexts as ``spans.matches`` cuts them."""
    bio = spans.matches(docs.where(is_bio(F.col("text"))), BIO_CANDIDATE, keep, **around)
    legal = spans.matches(docs.where(is_legal(F.col("text"))), LEGAL_CANDIDATE, keep, **around)
    return bio.unionByName(legal)


def keep_guard(surface: Column, near: Column) -> Column:
    """DOM-07: RNA-like tokens, and two-letter statistics with a number nearby. Nothing calls it; it is offered as it is."""
    return surface.isin("mRNA", "miRNA", "sgRNA") | (surface.isin("IL", "TN", "HR", "OR", "RR") & (near.rlike(r"\b\d{1,3}%\s*CI\b") | near.rlike(r"\b(OR|HR|RR)\s*(?:=|≈|~)?\s*\d")))


#: DOM-08: domains by name.
REGISTRY = {"bio": is_bio, "legal": is_legal}
