"""Fragments shared by the check SQL."""


def norm(col: str) -> str:
    return f"trim(regexp_replace(lower({col}), '\\s+', ' ', 'g'))"


def word_list(col: str) -> str:
    flat = f"trim(regexp_replace({col}, '\\s+', ' ', 'g'))"
    return f"(CASE WHEN {flat} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split({flat}, ' ') END)"


def strict(col: str) -> str:
    low = f"translate({col}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_replace({low}, '[!-/:-@\\[-`{{-~]', '', 'g')"


def grams(source: str, ids: str, n: int, text: str | None = None) -> str:
    """SELECT of (ids, ngram); ``text`` is the already normalized expression."""
    text = text or norm("text")
    return (
        f"SELECT {ids + ',' if ids else ''} unnest(list_transform(range(1, len(w) - {n} + 2), "
        f"lambda i: array_to_string(w[i:i + {n} - 1], ' '))) AS ngram "
        f"FROM (SELECT {ids + ',' if ids else ''} {word_list(text)} AS w FROM {source})"
    )
