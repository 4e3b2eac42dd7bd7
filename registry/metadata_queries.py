"""Identity parsing, names, keys, labels, parameter lists, limits and path predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermal_lake.functions import geometry as G
from thermal_lake.functions import metadata as M
from thermal_lake.functions import textfmt as X

from . import standins as S
from .core import R, query, rnd, sub, view

CAT = sub(S.CATALOG)


def num(e: str) -> str:
    return f"try_cast(replace(lower({e}), 'p', '.') AS DOUBLE)"


_NUM = "[0-9]+(?:[p.][0-9]+)?"


def words_sql(source: str, between: str = "/", within: str = "_") -> str:
    """One row for each word w of the text s of every row: its segment k, place j, order i, whether it ends there, and the next word of the segment."""
    return f"""SELECT *, lead(w) OVER (PARTITION BY rid, k ORDER BY j) AS nxt, k * 1000 + j AS i FROM (
  SELECT rid, k, seg, generate_subscripts(ws, 1) AS j, unnest(ws) AS w FROM (
   SELECT rid, k, seg, regexp_split_to_array(lower(seg), '{within}') AS ws FROM (
    SELECT rid, generate_subscripts(segs, 1) AS k, unnest(segs) AS seg FROM (SELECT rid, string_split(s, '{between}') AS segs FROM {source}))))"""


def earliest(value: str, where: str) -> str:
    return f"arg_min({value}, i) FILTER (WHERE {where})"


def has(text: str, pattern: str) -> str:
    return f"regexp_full_match({text}, '{pattern}')"


def digits(text: str) -> str:
    """The first number in a word that was recognised."""
    return f"regexp_extract({text}, '{_NUM}')"


def identity_sql(source: str, path: str = "ruta") -> str:
    """SELECT source.*, parsed identity columns (prefix i_): words as rows, the earliest match of each kind by arg_min."""
    names = {"una": 1, "dos": 2, "tres": 3, "cuatro": 4}
    places = {w: k for k, w in enumerate("primer segundo tercer cuarto quinto sexto septimo octavo noveno decimo".split(), 1)}
    spoken = lambda table, noun, head: "list_min([" + ", ".join(f"CASE WHEN regexp_matches(low, '{head}{w}\\s+{noun}') THEN {k}.0 END" for w, k in table.items()) + "])"
    key = lambda name, rest: f"arg_min(substr(seg, {len(name) + 2}), i) FILTER (WHERE j = 1 AND starts_with(lower(seg), '{name}_') AND {has(f'lower(substr(seg, {len(name) + 2}))', rest)})"
    return f"""(WITH src AS MATERIALIZED (SELECT *, row_number() OVER () AS rid, replace({path}, chr(92), '/') AS s FROM ({source}) src0),
word AS ({words_sql('src')}),
part AS (SELECT rid,
  coalesce({earliest(digits('w'), f"{has('w', '[0-9]+ *(ant|antenas)')} OR {has('w', '[0-9]+ *')} AND nxt IN ('ant', 'antenas')")}) AS ant,
  {earliest(f"CASE WHEN w = 'caso' THEN nxt ELSE substr(w, 2) END", f"{has('w', 'c[0-9]+')} OR w = 'caso' AND {has('nxt', '[0-9]+')}")} AS caso,
  {earliest(f"rtrim(rtrim(regexp_extract(w, '{_NUM} *w'), 'w'))", f"regexp_matches(w, '{_NUM} *w')")} AS watt,
  {earliest(f"CASE WHEN w = 'potencia' THEN nxt ELSE substr(w, 2) END", f"{has('w', 'p' + _NUM)} OR w = 'potencia' AND {has('nxt', _NUM)}")} AS pot,
  {earliest(digits('w'), f"(k = 1 OR j > 1) AND ({has('w', _NUM + ' *min')} OR {has('w', _NUM + ' *')} AND nxt = 'min')")} AS mins,
  {key('fecha', '.+')} AS fecha, {key('tiempo', _NUM + 'min')} AS tiempo, {key('prueba', '[0-9]+')} AS prueba, {key('zonas', '[0-9]+')} AS zonas
  FROM word GROUP BY rid),
tag AS (SELECT rid, low, strpos(low, 'correccion_') AS a, strpos(low, 'min_prueba_') AS b, strpos(low, '_zonas_') AS c FROM (SELECT rid, lower(s) AS low FROM src) WHERE strpos(low, 'correccion_') > 0),
cuts AS (SELECT src.rid, string_split(substr(src.s, a + 11, b - a - 11), '_') AS head, substr(src.s, b + 11, c - b - 11) AS test, regexp_extract(substr(src.s, c + 7), '^[0-9]+') AS zones
  FROM tag JOIN src USING (rid) WHERE b > a AND c > b),
combined AS (SELECT rid, array_to_string(head[:-2], '_') AS fecha, head[-1] AS mins, test, zones FROM cuts
  WHERE len(head) > 1 AND {has('head[-1]', '[0-9]+(p[0-9]+)?')} AND {has('test', '[0-9]+')} AND zones <> '')
SELECT *, CAST(CAST(round(i_num_antenas) AS INT) AS VARCHAR) || 'ant' AS i_antena, 'Zonas_' || CAST(CAST(round(i_num_zonas) AS INT) AS VARCHAR) AS i_zona_experimental,
  (i_tipo IS NOT NULL AND i_num_antenas IS NOT NULL AND i_caso IS NOT NULL AND i_potencia_w IS NOT NULL) AS i_sim,
  (i_fecha IS NOT NULL AND i_tiempo IS NOT NULL AND i_prueba IS NOT NULL AND i_num_zonas IS NOT NULL) AS i_acq
FROM (SELECT src2.* EXCLUDE (low),
  CASE WHEN contains(low, 'doble_slot') THEN 'Doble_slot' WHEN contains(low, 'monopolo') THEN 'Monopolo' WHEN contains(low, 'un_slot') THEN 'Un_slot' END AS i_tipo,
  coalesce({num('ant')}, {spoken(names, 'antenas?', '(^|/)')}) AS i_num_antenas, {num('caso_')} AS i_caso, coalesce({num('watt')}, {num('pot')}) AS i_potencia_w,
  coalesce(part.fecha, combined.fecha) AS i_fecha, coalesce({num("replace(lower(part.tiempo), 'min', '')")}, {num('part.mins')}, {num('combined.mins')}) AS i_tiempo,
  coalesce({num('part.prueba')}, {spoken(places, 'experimento', '')}, {num('test')}) AS i_prueba, coalesce({num('part.zonas')}, {num('zones')}) AS i_num_zonas
  FROM (SELECT *, lower(s) AS low FROM src) src2 LEFT JOIN (SELECT * EXCLUDE (caso), caso AS caso_ FROM part) part USING (rid) LEFT JOIN combined USING (rid)) parsed)"""


IDENT = identity_sql(f"SELECT seq, ruta FROM ({CAT}) c")


@query("P1_path_identity", f"""SELECT seq, ruta, i_tipo AS tipo, i_antena AS antena, i_num_antenas AS num_antenas, i_caso AS caso, i_potencia_w AS potencia_w,
 i_fecha AS fecha_adquisicion, i_tiempo AS tiempo_ejecucion_min, i_prueba AS numero_prueba, i_num_zonas AS num_zonas, i_zona_experimental AS zona_experimental,
 i_sim AS completa_simulacion, i_acq AS completa_adquisicion FROM ({IDENT}) t""")
def path_identity(spark, d):
    return M.with_identity(view(spark, d, S.CATALOG).select("seq", "ruta"), "ruta")


TAGS = """SELECT o_orderkey, concat(CASE o_orderkey % 4 WHEN 0 THEN 'dset_c' WHEN 1 THEN 'caso_' WHEN 2 THEN 'x-caso' ELSE 'modelo_' END, CAST(o_orderkey % 9 AS STRING),
 CASE o_orderkey % 5 WHEN 0 THEN '_p' WHEN 1 THEN '-potencia_' WHEN 2 THEN '_P' WHEN 3 THEN '_' ELSE '_q' END, CAST(o_custkey % 60 AS STRING),
 CASE o_orderkey % 3 WHEN 0 THEN 'W' WHEN 1 THEN '' ELSE '_v2' END) AS tag FROM {orders}"""


def tag_sql(source: str, column: str) -> str:
    """SELECT source.*, tc, tp: case and power of a tag, read word by word."""
    return f"""(WITH src AS MATERIALIZED (SELECT *, row_number() OVER () AS rid, {column} AS s FROM ({source}) src0), word AS ({words_sql('src', '//', '[_-]')}),
found AS (SELECT rid, {earliest("coalesce(CASE WHEN w IN ('c', 'caso') THEN nxt END, regexp_extract(w, '[0-9]+'))", f"{has('w', '(c|caso)[0-9]+')} OR w IN ('c', 'caso') AND {has('nxt', '[0-9]+')}")} AS fc,
 {earliest("regexp_extract(CASE WHEN w IN ('p', 'potencia') THEN nxt ELSE w END, '[0-9]+')", f"{has('w', '(p|potencia)[0-9]+w?')} OR w IN ('p', 'potencia') AND {has('nxt', '[0-9]+w?')}")} AS fp,
 {earliest("rtrim(rtrim(regexp_extract(w, '[0-9]+ *w'), 'w'))", "regexp_matches(w, '[0-9]+ *w')")} AS fw FROM word GROUP BY rid)
SELECT src.*, CAST(fc AS DOUBLE) AS tc, CAST(coalesce(fp, fw) AS DOUBLE) AS tp FROM src LEFT JOIN found USING (rid))"""


@query("P2_tag_identity", f"""SELECT o_orderkey, tag, CASE WHEN tc IS NOT NULL AND tp IS NOT NULL THEN tc END AS caso, CASE WHEN tc IS NOT NULL AND tp IS NOT NULL THEN tp END AS potencia_w
FROM {tag_sql(sub(TAGS), 'tag')} t""")
def tag_identity(spark, d):
    case, power = M.tag_identity("tag")
    return view(spark, d, TAGS).withColumns({"caso": case, "potencia_w": power})


PREC = f"""SELECT seq, ruta, dataset, CASE WHEN seq % 3 = 0 THEN caso + 1 END AS caso_meta, CASE WHEN seq % 4 = 0 THEN potencia_w + 1 END AS pot_meta,
 CASE WHEN seq % 6 = 1 THEN 'Otro' WHEN seq % 6 = 2 THEN '' END AS tipo_meta FROM ({S.CATALOG}) c"""


@query("P3_metadata_precedence", f"""SELECT seq, coalesce(nullif(tipo_meta, ''), i_tipo) AS tipo,
 coalesce(caso_meta, CASE WHEN tc IS NOT NULL AND tp IS NOT NULL THEN tc END, i_caso) AS caso,
 coalesce(pot_meta, CASE WHEN tc IS NOT NULL AND tp IS NOT NULL THEN tp END, i_potencia_w) AS potencia_w
FROM {tag_sql(f"SELECT * EXCLUDE (rid, s) FROM {identity_sql(sub(PREC))} t", 'dataset')} u""")
def metadata_precedence(spark, d):
    case_tag, power_tag = M.tag_identity("dataset")
    c = M.with_identity(view(spark, d, PREC), "ruta", {"tipo": "tipo_meta"})
    return c.select("seq", "tipo", M.first_known(F.col("caso_meta"), case_tag, F.col("caso")).alias("caso"),
                    M.first_known(F.col("pot_meta"), power_tag, F.col("potencia_w")).alias("potencia_w"))


@query("P4_completeness", f"""SELECT seq, m = '' AS es_util, CASE WHEN m = '' THEN 'metadata valida' ELSE 'metadata incompleta: ' || m END AS motivo
FROM (SELECT seq, concat_ws(', ', CASE WHEN i_tipo IS NULL THEN 'tipo' END, CASE WHEN i_num_antenas IS NULL THEN 'antenas' END,
 CASE WHEN i_caso IS NULL THEN 'caso' END, CASE WHEN i_potencia_w IS NULL THEN 'potencia' END) AS m FROM ({IDENT}) t) u""")
def completeness(spark, d):
    i = M.identity_columns()
    usable, reason = M.usability(i["tipo"], i["num_antenas"], i["caso"], i["potencia_w"])
    return M.with_identity(view(spark, d, S.CATALOG).select("seq", "ruta")).select("seq", usable.alias("es_util"), reason.alias("motivo"))


NAMES = """SELECT p_partkey, concat(CASE p_partkey % 4 WHEN 0 THEN '__' WHEN 1 THEN '9' WHEN 2 THEN 'Corr_' ELSE '' END, p_name, ' (', p_brand, ') ', p_type,
 CASE p_partkey % 3 WHEN 0 THEN '--x.mph' WHEN 1 THEN '___' ELSE repeat(' abc', 20) END) AS raw FROM {part}"""


def _clip(e: str, n: int) -> str:
    return f"CASE WHEN length({e}) > {n} THEN regexp_replace(substring({e}, 1, {n}), '_+$', '') ELSE {e} END"


def _word(trim: bool = True) -> str:
    e = "regexp_replace(lower(regexp_replace(raw, '[^\\w]+', '_', 'g')), '_+', '_', 'g')"
    return f"regexp_replace({e}, '^_+|_+$', '', 'g')"


_TAGX = "regexp_replace(regexp_replace(raw, '[^a-zA-Z0-9_]', '_', 'g'), '_+', '_', 'g')"
_FLD = "regexp_replace(regexp_replace(raw, '\\.mph$', '', 'i'), '[^a-zA-Z0-9_]', '_', 'g')"


@query("P5_sanitize_names", f"""SELECT p_partkey,
 regexp_replace(regexp_replace(regexp_replace(raw, '[^\\w.-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS partition_name,
 CASE WHEN regexp_matches({_TAGX}, '^[a-zA-Z]') THEN {_TAGX} ELSE 'T_' || {_TAGX} END AS tag_name,
 regexp_replace(regexp_replace(regexp_replace(raw, '[^a-zA-Z0-9_-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS segment_name,
 {_clip(_word(), 24)} AS file24, {_clip(_word(), 32)} AS file32, {_clip(_word(), 48)} AS file48,
 {_clip(f"regexp_replace({_word()}, '^corr_', '')", 72)} AS correction_name,
 CASE WHEN regexp_matches({_FLD}, '^[^0-9]') THEN {_FLD} ELSE 'm_' || {_FLD} END AS field_name FROM ({sub(NAMES)}) t""")
def sanitize_names(spark, d):
    rules = {"partition_name": "partition", "tag_name": "tag", "segment_name": "segment", "file24": "file24", "file32": "file32",
             "file48": "file48", "correction_name": "correction", "field_name": "field"}
    return view(spark, d, NAMES).select("p_partkey", *[X.sanitize("raw", r).alias(n) for n, r in rules.items()])


SHORT = """SELECT p_partkey, concat(CASE p_partkey % 3 WHEN 0 THEN 'corr_' ELSE 'Correccion ' END, CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE concat(CAST(p_partkey % 4 + 1 AS STRING), ' antenas_') END,
 CASE WHEN p_size % 2 = 0 THEN concat(CAST(p_size AS STRING), ' watt ') ELSE '' END, CASE WHEN p_size % 3 = 0 THEN '15min ' ELSE '' END,
 CASE WHEN p_size % 7 = 0 THEN 'zonas4' ELSE '' END, CASE WHEN p_size % 11 = 0 THEN '_2' ELSE '' END) AS raw FROM {part}"""


def _count(unit: str) -> str:
    """First digits before ``unit``: in one word, or at the end of a word whose next one begins with it."""
    own, split = f"regexp_matches(w, '[0-9]{unit}')", f"regexp_matches(w, '[0-9]$') AND starts_with(nxt, '{unit}')"
    return earliest(f"CASE WHEN {own} THEN rtrim(regexp_extract(w, '[0-9]+{unit}'), '{unit}') ELSE regexp_extract(w, '[0-9]+$') END", f"{own} OR {split}")


@query("P6_short_correction_tag", f"""WITH src AS (SELECT *, p_partkey AS rid, n AS s FROM (SELECT *, {_word()} AS n FROM ({sub(SHORT)}) t)), word AS ({words_sql('src', '//')}),
found AS (SELECT rid, {_count('ant')} AS a, {_count('w')} AS watt, {_count('min')} AS m, {earliest("regexp_extract(regexp_extract(w, 'zonas?[0-9]+'), '[0-9]+')", "regexp_matches(w, 'zonas?[0-9]')")} AS z,
 arg_max(w, i) AS last, count(*) AS many FROM word GROUP BY rid)
SELECT p_partkey, raw, coalesce(nullif(rtrim(coalesce(nullif(concat_ws('_', a || 'ant', watt || 'w', m || 'min', 'z' || z, 'r' || CASE WHEN many > 1 AND regexp_full_match(last, '[0-9]+') THEN last END), ''),
 substr(CASE WHEN starts_with(n, 'corr_') THEN substr(n, 6) ELSE n END, 1, 32)), '_'), ''), 'correccion') AS tag FROM src JOIN found USING (rid)""")
def short_tag(spark, d):
    return view(spark, d, SHORT).withColumn("tag", X.short_correction_tag("raw"))


def gs(e: str) -> str:
    return f"printf('%g', {e})"


def gp(e: str) -> str:
    return f"replace({gs(e)}, '.', 'p')"


_FOLD = f"""concat_ws('/', coalesce(i_tipo, 'Tipo_desconocido'), coalesce(i_antena, 'antenas_desconocidas'),
 coalesce('Caso_' || CAST(CAST(round(i_caso) AS INT) AS VARCHAR), 'Caso_desconocido'), coalesce('Potencia_' || {gp('i_potencia_w')} || 'W', 'Potencia_desconocida'))"""
_ACQ = f"""CASE WHEN i_acq THEN 'Fecha_' || i_fecha || '/Tiempo_' || {gp('i_tiempo')} || 'min/Prueba_' || CAST(CAST(i_prueba AS INT) AS VARCHAR) || '/Zonas_' || CAST(CAST(i_num_zonas AS INT) AS VARCHAR) END"""


@query("P7_canonical_paths", f"""SELECT seq, {_FOLD} AS carpeta, {_ACQ} AS adquisicion,
 CASE WHEN i_sim THEN {_FOLD} || CASE WHEN i_acq THEN '/Fecha_' || i_fecha || '/Tiempo_' || {gs('i_tiempo')} || 'min/Prueba_' || CAST(CAST(i_prueba AS INT) AS VARCHAR) || '/Zonas_' || CAST(CAST(i_num_zonas AS INT) AS VARCHAR) ELSE '' END || '/Correccion_termica_zonal.mat'
 ELSE 'metadata_incompleta/Correccion_termica_zonal.mat' END AS correccion FROM ({IDENT}) t""")
def canonical_paths(spark, d):
    i = M.identity_columns()
    return M.with_identity(view(spark, d, S.CATALOG).select("seq", "ruta")).select(
        "seq", M.partition_folder(i["tipo"], i["antena"], i["caso"], i["potencia_w"]).alias("carpeta"),
        M.acquisition_folder(i["fecha_adquisicion"], i["tiempo_ejecucion_min"], i["numero_prueba"], i["num_zonas"]).alias("adquisicion"),
        M.correction_path(i, F.lit("Correccion_termica_zonal.mat")).alias("correccion"))


def _without_last(words: str, last: str) -> str:
    return f"CASE WHEN len({words}) > 1 AND {has(f'lower({words}[-1])', last)} THEN {words}[:-2] ELSE {words} END"


_SRC = "list_last(regexp_split_to_array(modelo, '(?i)__src_'))"
_CUT = f"string_split(CASE WHEN contains(lower(modelo), '__src_') AND {has(f'lower({_SRC})', '[^_]+(_r[0-9]+)?')} THEN left(modelo, length(modelo) - length({_SRC}) - 6) ELSE modelo END, '_')"
_BM = f"array_to_string({_without_last('(' + _without_last(_CUT, 'pendientes') + ')', 'r[0-9]+')}, '_')"
_BD = f"'dset_c' || CAST(CAST(caso AS INT) AS VARCHAR) || '_p' || {gs('potencia_w')}"
SEM = f"lower(concat_ws('|', {_BM}, {_BD}, tipo, antena, 'c' || {gs('caso')}, 'p' || {gs('potencia_w')}))"


@query("P8_keys", f"""SELECT seq, modelo || '__' || dataset AS clave_particion, {SEM} AS clave_semantica, lower(concat_ws('__', modelo, dataset, fecha, tiempo, prueba, zonas)) AS clave_visual,
 concat_ws('|', 'original', tipo, antena, {gs('caso')}, fecha, tiempo, prueba, zonas) AS clave_colocacion FROM ({CAT}) c""")
def keys(spark, d):
    c = F.col
    return view(spark, d, S.CATALOG).select(
        "seq", M.partition_key(c("modelo"), c("dataset")).alias("clave_particion"),
        M.semantic_key(M.base_model("modelo"), M.base_dataset("dataset", c("caso"), c("potencia_w")), c("tipo"), c("antena"), c("caso"), c("potencia_w")).alias("clave_semantica"),
        M.visual_key(c("modelo"), c("dataset"), F.lit(""), c("fecha"), c("tiempo"), c("prueba"), c("zonas")).alias("clave_visual"),
        M.placement_key(F.lit("original"), c("tipo"), c("antena"), X.g("caso"), c("fecha"), c("tiempo"), c("prueba"), c("zonas")).alias("clave_colocacion"))


@query("P9_normalised_names", f"SELECT seq, {_BM} AS modelo_base, CASE WHEN seq % 3 = 0 THEN lower(dataset) ELSE {_BD} END AS dataset_base FROM ({CAT}) c")
def normalised_names(spark, d):
    case = F.when(F.col("seq") % 3 != 0, F.col("caso"))
    return view(spark, d, S.CATALOG).select("seq", M.base_model("modelo").alias("modelo_base"), M.base_dataset("dataset", case, F.col("potencia_w")).alias("dataset_base"))


TOKENS = """SELECT p_partkey, concat(CASE p_partkey % 4 WHEN 0 THEN 'Caso_' WHEN 1 THEN 'c' WHEN 2 THEN 'caso ' ELSE '' END, CAST(p_partkey % 9 AS STRING)) AS caso_txt,
 concat(CASE p_partkey % 3 WHEN 0 THEN 'Potencia_' WHEN 1 THEN 'p' ELSE '' END, CAST(p_size AS STRING), CASE WHEN p_size % 2 = 0 THEN 'p5' ELSE '' END, CASE WHEN p_size % 3 = 0 THEN 'W' ELSE '' END) AS pot_txt, p_name FROM {part}"""


@query("P10_numeric_tokens", f"""SELECT p_partkey, try_cast(replace(regexp_replace(replace(lower(caso_txt), ' ', ''), '^(caso_|caso|c)', ''), 'p', '.') AS DOUBLE) AS caso,
 try_cast(replace(regexp_replace(regexp_replace(replace(lower(pot_txt), ' ', ''), '^(potencia_|potencia|p)', ''), 'w$', ''), 'p', '.') AS DOUBLE) AS potencia,
 try_cast(replace(nullif(regexp_extract(lower(pot_txt), '([-+]?\\d+(?:[p.]\\d+)?)', 1), ''), 'p', '.') AS DOUBLE) AS primero,
 try_cast(replace(nullif(regexp_extract(lower(p_name), '([-+]?\\d+(?:[p.]\\d+)?)', 1), ''), 'p', '.') AS DOUBLE) AS sin_numero FROM ({sub(TOKENS)}) t""")
def numeric_tokens(spark, d):
    return view(spark, d, TOKENS).select(
        "p_partkey", X.labelled_number("caso_txt", "caso").alias("caso"), X.labelled_number("pot_txt", "potencia").alias("potencia"),
        X.number_in_text("pot_txt").alias("primero"), X.number_in_text("p_name").alias("sin_numero"))


@query("P11_labels", f"""SELECT seq, concat_ws(' | ', modelo, dataset, tipo, antena, 'Caso_' || {gs('caso')}, CASE WHEN seq % 4 > 0 THEN {gs('potencia_w')} || 'W' END, 'Fecha_' || fecha, tiempo, prueba, zonas) AS etiqueta
FROM ({CAT}) c""")
def labels(spark, d):
    c = F.col
    power = F.when(c("seq") % 4 > 0, F.concat(X.g("potencia_w"), F.lit("W"))).otherwise(F.lit(""))
    return view(spark, d, S.CATALOG).select("seq", M.catalog_label(
        c("modelo"), c("dataset"), c("tipo"), c("antena"), F.concat(F.lit("Caso_"), X.g("caso")), power, c("fecha"), c("tiempo"), c("prueba"), c("zonas")).alias("etiqueta"))


TRUTH = """SELECT doc_id, quality, CASE doc_id % 6 WHEN 0 THEN 'Si' WHEN 1 THEN 'TRUE' WHEN 2 THEN '1' WHEN 3 THEN 'no' WHEN 4 THEN 'yes' ELSE '' END AS word FROM {labels}"""


@query("P12_truthiness", f"SELECT doc_id, lower(word) IN ('1', 'true', 'si', 'yes') AS por_texto, quality <> 0 AS por_numero FROM ({sub(TRUTH)}) t")
def truthiness(spark, d):
    return view(spark, d, TRUTH).select("doc_id", X.truthy_text("word").alias("por_texto"), X.truthy_number("quality").alias("por_numero"))


RANGES = """SELECT p_partkey, CAST(p_partkey % 13 AS INT) AS a, CAST(p_partkey % 13 + p_size AS INT) AS b, CAST(p_partkey % 7 + 1 AS INT) AS s,
 CASE p_partkey % 4 WHEN 0 THEN 'todos' WHEN 1 THEN concat(CAST(p_size AS STRING), ', 3; 3 ', CAST(p_partkey % 9 AS STRING)) WHEN 2 THEN '5 7 x 999' ELSE concat(' ', CAST(p_size AS STRING), ';8 ') END AS lista FROM {part}"""


@query("P13_parameter_lists", f"""WITH r AS ({sub(RANGES)}),
 seqs AS (SELECT p_partkey, unnest(CASE WHEN list_contains(generate_series(a, b, s), b) THEN generate_series(a, b, s) ELSE list_append(generate_series(a, b, s), b) END) AS v FROM r),
 agg AS (SELECT p_partkey, string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) AS rango FROM seqs GROUP BY 1),
 tok AS (SELECT p_partkey, u.i, try_cast(u.w AS DOUBLE) AS v FROM r, LATERAL (SELECT unnest(regexp_split_to_array(trim(lista), '[,;\\s]+')) AS w, generate_subscripts(regexp_split_to_array(trim(lista), '[,;\\s]+'), 1) AS i) u),
 firsts AS (SELECT p_partkey, CAST(round(v) AS INT) AS v, min(i) AS i FROM tok WHERE v IS NOT NULL GROUP BY 1, 2),
 lists AS (SELECT p_partkey, string_agg(CAST(v AS VARCHAR), ',' ORDER BY i) AS lista, min(v) AS lo, max(v) AS hi FROM firsts GROUP BY 1)
SELECT r.p_partkey, agg.rango, CASE WHEN trim(r.lista) <> 'todos' AND lo >= 0 AND hi <= 100 THEN lists.lista END AS lista FROM r JOIN agg USING (p_partkey) LEFT JOIN lists USING (p_partkey)""")
def parameter_lists(spark, d):
    join = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return view(spark, d, RANGES).select("p_partkey", join(F.array_sort(X.int_range(F.col("a"), F.col("b"), F.col("s")))).alias("rango"),
                                         join(X.int_list("lista", 0, 100)).alias("lista"))


PROBES = f"""SELECT seq, ruta, CAST(seq % 5 AS DOUBLE) AS x, CAST(seq % 3 AS DOUBLE) AS y, CAST(18.6 + 6.6 * (seq % 4) AS DOUBLE) AS z FROM ({S.CATALOG}) c"""


@query("P18_single_antenna_shift", f"""SELECT seq, CASE WHEN h THEN 1.0E0 ELSE x END AS x, CASE WHEN h THEN 1.0E0 ELSE y END AS y, z, h AS movida, CASE WHEN h AND abs(z - 18.6E0) <= 1e-9 THEN 2.0E0 ELSE x END AS x_solo_z
FROM (SELECT *, contains(lower(ruta), '1ant') AS h FROM ({sub(PROBES)}) t) u""")
def single_antenna_shift(spark, d):
    p = view(spark, d, PROBES)
    xyz = (F.col("x"), F.col("y"), F.col("z"))
    (x, y, z), hit = G.shift_single_antenna(F.col("ruta"), xyz)
    (xz, _, _), _ = G.shift_single_antenna(F.col("ruta"), xyz, 2.0, 2.0, only_z=18.6)
    return p.select("seq", x.alias("x"), y.alias("y"), z.alias("z"), hit.alias("movida"), xz.alias("x_solo_z"))


@query("P19_antenna_layout", f"""WITH l(n, antenna, x, y) AS (VALUES (1, 1, 0.0, 0.0), (2, 1, -10.0, 0.0), (2, 2, 10.0, 0.0), (3, 1, 0.0, 20 / sqrt(3.0)), (3, 2, 10.0, -20 / sqrt(3.0) / 2), (3, 3, -10.0, -20 / sqrt(3.0) / 2),
 (4, 1, -10.0, -10.0), (4, 2, 10.0, -10.0), (4, 3, -10.0, 10.0), (4, 4, 10.0, 10.0))
SELECT s_suppkey, CAST(l.n AS INT) AS num_antenas, CAST(antenna AS INT) AS antenna, {R('CAST(x AS DOUBLE)')} AS x, {R('CAST(y AS DOUBLE)')} AS y FROM supplier JOIN l ON l.n = s_suppkey % 4 + 1""")
def antenna_layout(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", (F.col("s_suppkey") % 4 + 1).cast("int").alias("num_antenas"))
    return s.join(F.broadcast(G.antenna_layout(spark)), "num_antenas").select("s_suppkey", "num_antenas", F.col("antenna"), rnd("x").alias("x"), rnd("y").alias("y")) \
        .withColumnRenamed("antenna", "antenna")


@query("P20_case_limits", f"""SELECT seq, CASE WHEN caso = 0 THEN 500.0E0 WHEN caso BETWEEN 1 AND 8 THEN 120.0E0 END AS carbon, CASE WHEN caso = 0 AND seq % 2 = 1 THEN 500.0E0 ELSE 120.0E0 END AS superficie,
 CASE WHEN num_antenas = 4 THEN 120.0E0 ELSE 100.0E0 END AS potencia_total FROM ({CAT}) c""")
def case_limits(spark, d):
    return view(spark, d, S.CATALOG).select("seq", G.carbon_limit(F.col("caso")).alias("carbon"), G.surface_limit(F.col("caso"), F.col("seq") % 2 == 0).alias("superficie"),
                                            G.total_power_limit(F.col("num_antenas")).alias("potencia_total"))


_Q = "list_contains(string_split(lower(replace(ruta, chr(92), '/')), '/'), 'repetidos')"


@query("F2_quarantine_exclusion", f"SELECT seq, ruta FROM ({CAT}) c WHERE NOT {_Q}")
def quarantine(spark, d):
    return view(spark, d, S.CATALOG).select("seq", "ruta").where(~M.quarantined("ruta"))


@query("F3_auxiliary_exclusion", f"""SELECT seq, ruta FROM (SELECT *, lower(regexp_extract(replace(ruta, chr(92), '/'), '[^/]*$', 0)) AS f FROM ({CAT}) c) t
WHERE f LIKE '%.mat' AND NOT (starts_with(f, 'indice_') OR starts_with(f, 'reporte_') OR contains(f, 'historial')) AND NOT {_Q}""")
def auxiliary(spark, d):
    return view(spark, d, S.CATALOG).select("seq", "ruta").where(M.eligible_file("ruta"))


@query("F11_early_time_rule", f"""SELECT seq, m, coalesce(m >= 1 AND m <= CASE WHEN contains(ruta, '1ant') THEN 0 WHEN contains(ruta, 'Potencia_10W') THEN 1 WHEN contains(ruta, 'Potencia_5W') AND (contains(ruta, '2ant') OR contains(ruta, '3ant')) THEN 2
 WHEN contains(ruta, 'Potencia_5W') AND contains(ruta, '4ant') THEN 3 ELSE 0 END, false) AS descartar FROM (SELECT seq, ruta, CAST(seq % 5 AS DOUBLE) AS m FROM ({CAT}) c) t""")
def early_rule(spark, d):
    return view(spark, d, S.CATALOG).select("seq", "ruta", (F.col("seq") % 5).cast("double").alias("m")).select("seq", "m", M.early_time("ruta", F.col("m")).alias("descartar"))


@query("C32_correction_tag", f"""SELECT seq, coalesce(CASE WHEN seq % 3 = 0 THEN fecha END, CASE WHEN seq % 3 = 1 THEN nullif(regexp_replace(regexp_extract(replace(ruta, chr(92), '/'), '[^/]*$', 0), '\\.[^.]*$', ''), '') END,
 CASE WHEN seq % 5 = 0 THEN dataset END, 'correccion') AS tag FROM ({CAT}) c""")
def correction_tag(spark, d):
    pick = lambda k, m, name: F.when(F.col("seq") % k == m, F.col(name)).otherwise(F.lit(""))
    return view(spark, d, S.CATALOG).select("seq", M.correction_tag(pick(3, 0, "fecha"), pick(3, 1, "ruta"), pick(5, 0, "dataset")).alias("tag"))
