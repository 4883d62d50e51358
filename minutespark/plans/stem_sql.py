"""The Snowball English stemmer in DuckDB's SQL, step by step, for the counterparts of searches by stems."""

from __future__ import annotations

from minutespark.functions import stemming as s


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


def _cases(endings: dict[str, str]) -> str:
    return " ".join(f"WHEN '{old}' THEN '{new}'" for old, new in endings.items())


def _ending(endings) -> str:
    """The longest ending of ``w``: the leftmost match is the longest one."""
    return f"regexp_extract(w, '({'|'.join(sorted(endings))})$')"


_SHORT = "'^(.*[^aeiouy])?[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$'"


def _after(word: str) -> str:
    """Characters up to the first consonant after a vowel, it included; all without one."""
    found = f"length(regexp_extract({word}, '^.*?[aeiouy][^aeiouy]'))"
    return f"CASE WHEN {found} > 0 THEN {found} ELSE length({word}) END"


def stems(words: str, word: str) -> str:
    """CTEs that end with ``stemmed`` (word, stem), for each distinct ``word`` (lower-case letters and digits) of the relation ``words``."""
    cut = "left(w, length(w) - length(e))"
    return f"""
k0 AS (SELECT DISTINCT {word} AS word FROM {words}),
k1 AS (SELECT word, regexp_replace(word, '(^|[aeiouy])y', '\\1Y', 'g') AS w FROM k0 WHERE length(word) > 2 AND word NOT IN ({_listed(s._KEPT | set(s._WHOLE))})),
k2 AS (SELECT *, CASE WHEN regexp_matches(w, '^(gener|commun|arsen)') THEN length(regexp_extract(w, '^(gener|commun|arsen)')) ELSE {_after("w")} END AS r1 FROM k1),
k3 AS (SELECT *, r1 + {_after("substr(w, r1 + 1)")} AS r2 FROM k2),
k4 AS (SELECT word, r1, r2, CASE WHEN w LIKE '%sses' THEN left(w, length(w) - 2) WHEN regexp_matches(w, 'ie[ds]$') THEN left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END)
  WHEN w LIKE '%s' AND NOT regexp_matches(w, '[us]s$') AND regexp_matches(left(w, length(w) - 2), '[aeiouy]') THEN left(w, length(w) - 1) ELSE w END AS w FROM k3),
k5 AS (SELECT *, w IN ({_listed(s._KEPT_AFTER_PLURAL)}) AS whole, regexp_extract(w, '(eedly|ingly|edly|eed|ing|ed)$') AS e FROM k4),
k6 AS (SELECT *, e NOT LIKE 'eed%' AND e <> '' AND regexp_matches({cut}, '[aeiouy]') AS cut,
  CASE WHEN e LIKE 'eed%' THEN CASE WHEN length(w) - length(e) >= r1 THEN {cut} || 'ee' ELSE w END WHEN e <> '' AND regexp_matches({cut}, '[aeiouy]') THEN {cut} ELSE w END AS w6 FROM k5),
k7 AS (SELECT word, r1, r2, whole, w AS plain, CASE WHEN NOT cut THEN w6 WHEN regexp_matches(w6, '(at|bl|iz)$') THEN w6 || 'e' WHEN regexp_matches(w6, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(w6, length(w6) - 1)
  WHEN length(w6) <= r1 AND regexp_matches(w6, {_SHORT}) THEN w6 || 'e' ELSE w6 END AS w FROM k6),
k8 AS (SELECT word, r1, r2, whole, plain, CASE WHEN length(w) > 2 AND regexp_matches(w, '[^aeiouy][yY]$') THEN left(w, length(w) - 1) || 'i' ELSE w END AS w FROM k7),
k9 AS (SELECT *, {_ending(s._STEP2)} AS e FROM k8),
k10 AS (SELECT word, r1, r2, whole, plain, CASE WHEN e <> '' AND length(w) - length(e) >= r1 AND (e <> 'ogi' OR {cut} LIKE '%l') AND (e <> 'li' OR regexp_matches({cut}, '[cdeghkmnrt]$'))
  THEN {cut} || CASE e {_cases(s._STEP2)} END ELSE w END AS w FROM k9),
k11 AS (SELECT *, {_ending(s._STEP3)} AS e FROM k10),
k12 AS (SELECT word, r1, r2, whole, plain, CASE WHEN e <> '' AND length(w) - length(e) >= CASE WHEN e = 'ative' THEN r2 ELSE r1 END THEN {cut} || CASE e {_cases(s._STEP3)} END ELSE w END AS w FROM k11),
k13 AS (SELECT *, {_ending(s._STEP4)} AS e FROM k12),
k14 AS (SELECT word, r1, r2, whole, plain, CASE WHEN e <> '' AND length(w) - length(e) >= r2 AND (e <> 'ion' OR regexp_matches({cut}, '[st]$')) THEN {cut} ELSE w END AS w FROM k13),
k15 AS (SELECT word, whole, plain, CASE WHEN w LIKE '%e' THEN CASE WHEN length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND NOT regexp_matches(left(w, length(w) - 1), {_SHORT})) THEN left(w, length(w) - 1) ELSE w END
  WHEN w LIKE '%ll' AND length(w) - 1 >= r2 THEN left(w, length(w) - 1) ELSE w END AS w FROM k14),
stemmed AS (SELECT word, CASE WHEN whole THEN plain ELSE replace(w, 'Y', 'y') END AS stem FROM k15
  UNION ALL SELECT word, CASE word {_cases(s._WHOLE)} ELSE word END FROM k0 WHERE length(word) <= 2 OR word IN ({_listed(s._KEPT | set(s._WHOLE))}))"""
