"""Queries of the problems on text."""

from __future__ import annotations

from codequarry.llm import handwritten, leakage, mixture, natural, pairs, parse_check, secrets, split
from codequarry.session import read_table as T

QUERIES = {
    "p2_found": lambda s, d: natural.language_rows(T(s, d, "parse_results")),
    "p2_language_shares": lambda s, d: natural.language_shares(T(s, d, "parse_results")),
    "p3_found": lambda s, d: pairs.documented_rows(T(s, d, "parse_results"), T(s, d, "parsed_entities")),
    "p3_code_pairs": lambda s, d: pairs.code_pairs(T(s, d, "parse_results"), T(s, d, "parsed_entities")),
    "p5_found": lambda s, d: handwritten.not_handwritten(T(s, d, "parse_results")),
    "p5_kinds": lambda s, d: handwritten.kind_counts(T(s, d, "parse_results")),
    "p5_handwritten_entities": lambda s, d: handwritten.handwritten_entities(T(s, d, "parse_results"), T(s, d, "entities"), T(s, d, "repos")),
    "p6_found": lambda s, d: secrets.secret_rows(T(s, d, "parse_results")),
    "p6_redacted": lambda s, d: secrets.redacted_files(T(s, d, "parse_results")),
    "p7_found": lambda s, d: parse_check.invalid_files(T(s, d, "parse_results")),
    "p7_invalid_rates": lambda s, d: parse_check.invalid_rates(T(s, d, "parse_results")),
    "p8_found": lambda s, d: leakage.leaks(T(s, d, "documents"), T(s, d, "benchmark")),
    "p8_near_leaks": lambda s, d: leakage.near_leaks(T(s, d, "documents"), T(s, d, "benchmark")),
    "p9_mixture": lambda s, d: mixture.mix(T(s, d, "documents"), T(s, d, "mix_targets")),
    "p9_shares": lambda s, d: mixture.shares(mixture.mix(T(s, d, "documents"), T(s, d, "mix_targets")), T(s, d, "mix_targets")),
    "p10_found": lambda s, d: split.oversized(T(s, d, "documents")),
    "p10_pieces": lambda s, d: split.split_documents(T(s, d, "documents")),
}

#: Full-width forms and their compatible ones; DuckDB composes (NFC) but has no compatible form (NFKC). What else the
#: texts hold of such characters stands between words either way.
_WIDE, _NARROW = "".join(chr(c + 0xFEE0) for c in range(33, 127)), "".join(chr(c) for c in range(33, 127)).replace("'", "''")
_TERMS = f"regexp_extract_all(replace(lower(nfc_normalize(translate(text, '{_WIDE}', '{_NARROW}'))), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+') AS w"
_GRAMS = "list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))"

SQL = {
    "p8_found": f"""WITH d AS (SELECT doc_id, {_TERMS} FROM documents WHERE text <> ''), b AS (SELECT item_id, {_TERMS} FROM benchmark WHERE text <> ''),
      dg AS (SELECT DISTINCT doc_id, unnest({_GRAMS}) AS g FROM d WHERE len(w) >= 12), bg AS (SELECT DISTINCT item_id, unnest({_GRAMS}) AS g FROM b WHERE len(w) >= 12)
      SELECT DISTINCT item_id, doc_id FROM dg JOIN bg USING (g)""",
    # A token of the common vocabularies has three to four bytes, and no text lies near the limit, so its bytes tell.
    "p10_found": "SELECT DISTINCT doc_id FROM documents WHERE strlen(text) > 3500",
}
