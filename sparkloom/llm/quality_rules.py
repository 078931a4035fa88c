"""Line-first cleaning: rules judge each line, failing lines go, then documents that lost too much go.

Rules, on a line with tabs as spaces and outer spaces trimmed (a blank line passes and stays):

* punctuation: ASCII punctuation beyond two marks makes up over DENSITY of the characters, or the
  line has fewer than SHORT words (in scripts that set no spaces between words: UNSPACED, fewer than
  SHORT_SIGNS characters) and doesn't end in one of ENDS, the sentence ends of many scripts;
* navigation: two or more of SEPARATORS, and one for every six words at least;
* repetition (boilerplate): of MANY words or more, under DISTINCT are different;
* boilerplate: at most 30 words, and a phrase of PHRASES (English, French, German, Spanish).

A document goes if its kept lines, joined, have under keep_share of its characters or are blank.

Defined results: null or empty text is rejected; null in other columns passes through; repeated rows
are each judged and kept; very long texts are split like any; an empty table gives an empty one; extra
columns pass through, whatever their names, as only text and n_chars are replaced (n_chars only where
the table has it); with report, lines and kept_lines replace columns of these names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textops import buffers, slices, word_table, words

DENSITY, SHORT, SHORT_SIGNS, MANY, DISTINCT, KEEP = 0.12, 6, 12, 20, 0.2, 0.5
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
ENDS = ".!?:;\"')]…»”’" + "。！？：；」』）】》．｡" + "؟۔؛" + "।॥" + "។៕" + "։" + "።፧" + "༎"
UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]"
SEPARATORS = "|•›»>"
PHRASES = "(?i)(accept (all )?cookies|cookie (policy|settings)|privacy policy|terms of (use|service)|all rights reserved|sign (up|in) (now|for|to)|log in to|subscribe (now|to)|click here|skip to (main )?content|back to top|read more|share this|enable javascript|lorem ipsum"
PHRASES += "|accepter (les|tous les) cookies|politique de (confidentialité|cookies)|mentions légales|tous droits réservés|(s'inscrire|inscrivez-vous) (maintenant|ici)|se connecter|abonnez-vous|cliquez ici|aller au contenu|haut de (la )?page|en savoir plus|lire la suite"
PHRASES += "|(alle )?cookies akzeptieren|cookie-(richtlinie|einstellungen)|datenschutzerklärung|nutzungsbedingungen|alle rechte vorbehalten|jetzt (anmelden|registrieren|abonnieren)|hier klicken|zum (haupt)?inhalt springen|nach oben|weiterlesen"
PHRASES += "|aceptar (todas )?(las )?cookies|política de (privacidad|cookies)|aviso legal|todos los derechos reservados|(regístrate|suscríbete) (ahora|aquí)|iniciar sesión|haz clic aquí|saltar al contenido|volver arriba|leer más)"


TABLES = {"marks": np.isin(np.arange(256), [ord(c) for c in MARKS]), "separators": np.isin(np.arange(256), [ord(c) for c in SEPARATORS if ord(c) < 128]), "words": word_table()}
TABLES["words"][[10, 11, 12]] = [10, 11, 12]


def line_passes(lines: pa.Array) -> np.ndarray:
    """Whether each line passes every rule."""
    t = pc.utf8_trim(lines, " \t\r")
    at, data = buffers(t)
    if at[-1] == at[0]:
        return np.ones(len(t), bool)
    data, at = data[at[0] : at[-1]], at - at[0]

    def count(hit: np.ndarray) -> np.ndarray:
        total = np.empty(len(hit) + 1, np.int64)
        total[0] = 0
        np.cumsum(hit, out=total[1:])
        return total[at[1:]] - total[at[:-1]]

    length, marks, separators = count((data & 0xC0) != 0x80), count(TABLES["marks"][data]), TABLES["separators"][data]
    for sign in SEPARATORS:
        code = sign.encode()
        if len(code) > 1 and len(data) >= len(code) and (data == code[0]).any():
            hit = np.ones(len(data) - len(code) + 1, bool)
            for i, b in enumerate(code):
                hit &= data[i : i + len(hit)] == b
            separators = separators.copy()
            separators[: len(hit)] |= hit
    separators = count(separators)
    cache: dict = {}
    n, different = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
    for lo, hi in slices(at):
        row, h, _, _ = words(at, data, lo, hi, TABLES["words"], cache)
        k = np.bincount(row, minlength=hi - lo)
        n[lo:hi] = k
        many = k[row] >= MANY
        row, h = row[many], h[many]
        if len(row):
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            new = np.concatenate(([True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])))
            different[lo:hi] = np.bincount(row[new], minlength=hi - lo)
    ends = np.array(pc.is_in(pc.utf8_slice_codeunits(t, -1, None), pa.array(list(ENDS))).to_numpy(zero_copy_only=False))
    boilerplate = np.zeros(len(t), bool)
    brief = np.flatnonzero((n > 0) & (n <= 30))
    if len(brief):
        boilerplate[brief] = pc.match_substring_regex(t.take(pa.array(brief)), PHRASES).to_numpy(zero_copy_only=False)
    short = np.flatnonzero(~ends & (n < SHORT))
    if len(short):
        unspaced = pc.match_substring_regex(t.take(pa.array(short)), UNSPACED).to_numpy(zero_copy_only=False)
        ends[short[unspaced & (length[short] >= SHORT_SIGNS)]] = True
    bad = (marks - 2 > DENSITY * length) | (~ends & (n < SHORT)) | ((separators >= 2) & (separators * 6 >= n)) | ((n >= MANY) & (different < DISTINCT * n)) | boilerplate
    return (length == 0) | ~bad


def clean(docs: DataFrame, keep_share: float = KEEP, text: str = "text", report: bool = False) -> DataFrame:
    """Cleaned documents that stay. With report, also the columns lines and kept_lines.

    One pass over Arrow batches without a shuffle. Rules run on byte arrays, all lines of a slice at a time.
    """
    docs = docs.drop("lines", "kept_lines") if report else docs
    columns = docs.columns
    schema = T.StructType([T.StructField(f.name, T.LongType() if f.name == "n_chars" else f.dataType, True) for f in docs.schema] + [T.StructField(c, T.IntegerType()) for c in ("lines", "kept_lines") if report])

    def run(batches):
        for batch in batches:
            at, _ = buffers(batch.column(columns.index(text)))
            for lo, hi in slices(at, 4 << 20):
                yield one(batch.slice(lo, hi - lo))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        whole = batch.column(columns.index(text))
        split = pc.split_pattern(pc.fill_null(whole, ""), "\n")
        flat = pc.list_flatten(split)
        lines = np.diff(np.asarray(split.offsets))
        passes = line_passes(flat)
        edge = np.concatenate(([0], np.cumsum(lines)))
        total = np.concatenate(([0], np.cumsum(passes)))
        kept = total[edge[1:]] - total[edge[:-1]]
        cleaned = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(kept))), pa.int32()), flat.filter(pa.array(passes))), "\n")
        before, after = pc.utf8_length(pc.fill_null(whole, "")).to_numpy(), pc.utf8_length(cleaned).to_numpy()
        blank = pc.utf8_length(pc.utf8_trim(cleaned, " \t\r\n")).to_numpy() == 0
        stays = pa.array((after >= keep_share * before) & ~blank)
        new = [cleaned if c == text else pa.array(after, pa.int64()) if c == "n_chars" else x for c, x in zip(columns, batch.columns)]
        new += [pa.array(lines, pa.int32()), pa.array(kept, pa.int32())] if report else []
        return pa.RecordBatch.from_arrays(new, schema.names).filter(stays)

    return docs.mapInArrow(run, schema)


def clean_sql(source: str = "documents", keep_share: float = KEEP, report: bool = False) -> str:
    """DuckDB SQL for clean() over a table with the columns of documents."""
    q = lambda s: s.replace("'", "''")
    return f"""
    SELECT doc_id, whole AS text, lang, source, length(whole)::BIGINT AS n_chars{", len(ls)::INT AS lines, len(kept)::INT AS kept_lines" if report else ""} FROM (
      SELECT *, array_to_string(kept, chr(10)) AS whole FROM (
        SELECT *, list_filter(ls, lambda x: list_transform([trim(translate(x, chr(9) || chr(13), '  '))], lambda t: list_transform([list_filter(string_split(t, ' '), lambda w: w <> '')], lambda ws:
          t = '' OR NOT (
            (length(t) - length(translate(t, '{q(MARKS)}', '')) - 2 > {DENSITY}::DOUBLE * length(t)) OR (strpos('{q(ENDS)}', right(t, 1)) = 0 AND len(ws) < {SHORT} AND NOT (length(t) >= {SHORT_SIGNS} AND regexp_matches(t, '{UNSPACED}')))
            OR (length(t) - length(translate(t, '{q(SEPARATORS)}', '')) >= 2 AND (length(t) - length(translate(t, '{q(SEPARATORS)}', ''))) * 6 >= len(ws))
            OR (len(ws) >= {MANY} AND len(list_distinct(ws)) < {DISTINCT}::DOUBLE * len(ws))
            OR (len(ws) <= 30 AND regexp_matches(t, '{q(PHRASES)}'))))[1])[1]) AS kept
        FROM (SELECT *, string_split(text, chr(10)) AS ls FROM {source} WHERE text IS NOT NULL)))
    WHERE length(whole) >= {keep_share} * length(text) AND trim(translate(whole, chr(9) || chr(13) || chr(10), '   ')) <> ''"""
