"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlane.llm import (
    alignment,
    language_id,
    line_dedup,
    merkle,
    mixing,
    near_dup,
    piece_bpe,
    pii,
    preferences,
    quality,
    simhash,
    sketches,
    suffix_dedup,
)
from postlane.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# Shares of the mixture: the largest source is halved, three small ones are raised.
MIXTURE = {"src0": 0.18, "src1": 0.08, "src2": 0.06, "src3": 0.01}
MIXTURE_REST = 0.67
MIXTURE_SEED = 20240


@query
def op1_mix_sources(spark, sf_dir):
    """The whole table repeated to target weights, in global random order."""
    docs = table(spark, sf_dir, "documents")
    return mixing.mix_sources(docs, MIXTURE, MIXTURE_REST, epochs=1.0, seed=MIXTURE_SEED)


ORACLE["op1_mix_sources"] = f"""
with weights(source, weight) as (values {", ".join(f"('{s}', {w}::double)" for s, w in MIXTURE.items())}),
grouped as (
  select d.*, coalesce(w.source, '\\') as grp, coalesce(w.weight, {MIXTURE_REST}::double) as weight
  from documents d left join weights w on d.source = w.source),
masses as (select grp, weight, sum(length(coalesce(text, ''))) as mass from grouped group by grp, weight),
rates as (
  select grp, case when mass > 0 then sum(mass) over () * weight
    / (select sum(weight) + {MIXTURE_REST} from weights) / mass else 1.0 end as rate from masses),
steps as (
  select grp, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) over (partition by grp order by k) as cdf
  from rates, (select unnest(range(0, 200)) as k) where rate > 0),
drawn as (
  select g.*, ('0x' || substr(md5('{MIXTURE_SEED}:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint
    / 4503599627370496.0::double as draw from grouped g),
-- One count per document: the steps at or below its draw.
counted as (
  select doc_id, draw, grp, (select count(*) from steps s where s.grp = d.grp and s.cdf <= d.draw) as copies
  from (select distinct doc_id, draw, grp from drawn) d)
select d.doc_id, d.text, d.lang, d.source, d.n_chars, c.copy_no::int as copy_no,
  ('0x' || substr(md5('{MIXTURE_SEED + 1}:' || coalesce(d.doc_id::varchar, 'null') || ':' || c.copy_no::varchar), 1, 13))::bigint
    as shuffle_key
from drawn d join (select doc_id, grp, unnest(range(1, copies + 1)) as copy_no from counted) c
  on d.doc_id is not distinct from c.doc_id and d.grp = c.grp
"""


@query
def op3_identify_language(spark, sf_dir):
    """Language of every whole text, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(~language_id.held_out()))
    return language_id.identify(docs, model).select(
        "doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "rejected"
    )


# Sites that a line must stand on to count as boilerplate.
MIN_SITES = 10


@query
def op6_remove_spread_lines(spark, sf_dir):
    """Every document without the lines that stand on ten sites or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.remove_spread_lines(docs, MIN_SITES)


ORACLE["op6_remove_spread_lines"] = f"""
with lines as (
  select doc_id, source, unnest(string_split(text, chr(10))) as line,
    unnest(range(len(string_split(text, chr(10))))) as no from documents where text is not null),
spread as (
  select line, min(struct_pack(d := doc_id, n := no)) as first from lines
  where translate(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') <> ''
  group by line having count(distinct coalesce('=' || source, 'null')) >= {MIN_SITES}),
flagged as (
  select l.*, s.line is not null and struct_pack(d := l.doc_id, n := l.no) <> s.first as gone
  from lines l left join spread s on l.line = s.line),
cleaned as (
  select doc_id, coalesce(string_agg(line, chr(10) order by no) filter (not gone), '') as text,
    count(*) as n_lines, count(*) filter (gone) as n_removed from flagged group by doc_id)
select d.doc_id, c.text, d.source, coalesce(c.n_lines, 0)::bigint as n_lines,
  coalesce(c.n_removed, 0)::bigint as n_removed
from documents d left join cleaned c using (doc_id)
"""


@query
def op8_judge_quality(spark, sf_dir):
    """Base figures of every whole text and the verdict of risk-controlled rules."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality.judge(docs, labels)


@query
def op5_fingerprint_documents(spark, sf_dir):
    """Sketches of every whole text and its edited text, compared with each other and the next."""
    return sketches.compare_with_edit(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op4_group_near_duplicates(spark, sf_dir):
    """Components of documents whose three-word shingle sets overlap by 85 percent."""
    return near_dup.near_duplicate_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op10_encode_pieces(spark, sf_dir):
    """Ids of every whole text and the text decoded from them, as counts and digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = public_tokenizers.path("piece_bpe_32k.model")
    return piece_bpe.digest_texts(docs, model).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op2_remove_repeats(spark, sf_dir):
    """Every document without the bytes of 400-byte strings that start elsewhere too."""
    cleaned = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.withColumn("n_kept", F.col("n_bytes") - F.col("n_removed"))


@query
def op7_format_preferences(spark, sf_dir):
    """Every conversation as a preference pair against a branch that goes on as the next one does."""
    return preferences.format_preferences(preferences.branch_pairs(table(spark, sf_dir, "conversations")))


def preference_twin() -> str:
    """Turn by turn: the first one in which the two sides differ ends the prompt."""
    line = (
        "'<|im_start|>' || coalesce(role, '') || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10)"
    )
    rendered = "".join(
        f"""
{side}_lines as (
  select s.conv_id, s.i, s.role, {line} as line, p.n_prompt
  from {side} s join prefix p on s.conv_id is not distinct from p.conv_id),
{side}_placed as (
  select *, coalesce(sum(length(line)) over (partition by conv_id order by i rows between unbounded preceding
    and 1 preceding), 0)::bigint as off from {side}_lines where i >= n_prompt),
{side}_shown as (
  select conv_id, string_agg(line, '' order by i) as shown, string_agg(
    (off + 22)::varchar || ':' || (off + length(line) - 1)::varchar, ',' order by i) filter (role = 'assistant') as mask
  from {side}_placed group by conv_id),"""
        for side in ("chosen", "rejected")
    )
    return f"""
with turns as (
  select conv_id, role, text, row_number() over (partition by conv_id order by turn, role, text) - 1 as i from conversations),
sized as (
  select conv_id, count(*) as n, list(i order by i) filter (role = 'assistant') as answers from turns group by conv_id),
branched as (
  select conv_id, n, coalesce(lead(conv_id) over (order by conv_id), min(conv_id) over ()) as rejected_conv,
    case when len(answers) > 0 then answers[('0x' || substr(md5('7:' || conv_id::varchar), 1, 13))::bigint % len(answers) + 1]
      else n end as branch from sized),
chosen as (select conv_id, i, role, text from turns),
rejected as (
  select b.conv_id, t.i, t.role, t.text from branched b join turns t on t.conv_id = b.conv_id and t.i < b.branch
  union all
  select b.conv_id, t.i, t.role, t.text from branched b join turns t on t.conv_id = b.rejected_conv and t.i >= b.branch),
differing as (
  select coalesce(c.conv_id, r.conv_id) as conv_id, min(coalesce(c.i, r.i)) as first
  from chosen c full join rejected r on c.conv_id = r.conv_id and c.i = r.i
  where c.i is null or r.i is null or c.role is distinct from r.role or c.text is distinct from r.text
  group by 1),
prefix as (
  select b.conv_id, b.rejected_conv, coalesce(d.first, b.n) as n_prompt from branched b left join differing d using (conv_id)),
{rendered}
prompts as (
  select conv_id, string_agg(line, '' order by i) as prompt from chosen_lines where i < n_prompt group by conv_id)
select p.conv_id, p.rejected_conv, p.n_prompt::bigint as n_prompt_turns, coalesce(m.prompt, '') as prompt,
  coalesce(c.shown, '') as chosen, coalesce(r.shown, '') as rejected,
  coalesce(c.mask, '') as chosen_mask, coalesce(r.mask, '') as rejected_mask
from prefix p left join prompts m using (conv_id) left join chosen_shown c using (conv_id)
  left join rejected_shown r using (conv_id)
"""


ORACLE["op7_format_preferences"] = preference_twin()


@query
def op9_find_personal_data(spark, sf_dir):
    """Personal data in every whole text, by patterns and by a field fitted on a sample."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find_personal_data(docs, pii.fit(docs)).drop("text")


@query
def op11_group_fingerprints(spark, sf_dir):
    """SimHash of every whole text, and the components of those within two bits."""
    return simhash.near_duplicate_prints(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op12_prove_documents(spark, sf_dir):
    """Merkle leaf, roots and proof of every row, and whether a tampered row still proves."""
    return merkle.manifest(table(spark, sf_dir, "documents"))


# Levels of a tree that the twin spells out: 16^5 documents a source, as many sources.
TWIN_LEVELS = 5


def merkle_twin(levels: int) -> str:
    """Levels one by one: nodes, what stands beside them in their runs, and the folds."""
    field = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')".format
    hashed = "sha256({})".format
    plain = hashed(" || ".join(field(c) for c in merkle.FIELDS))
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    altered = hashed(" || ".join(field(lowered if c == "text" else c) for c in merkle.FIELDS))
    # CRC-32 bit by bit, lowest bit of every byte first.
    bits = "flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [(ascii(c) >> k) & 1 for k in range(8)]))"
    step = "lambda c, b: xor(c >> 1, case when xor(c, b) & 1 = 1 then 3988292384 else 0 end)"
    crc = f"xor(list_reduce(list_prepend(4294967295::bigint, {bits}), {step}), 4294967295)"
    ctes = [
        f"leaves as (select doc_id, source, {plain} as leaf, {crc} % 5 = 0 as tampered, "
        f"{altered} as altered from documents)",
        "placed as (select *, coalesce('=' || source, '-') as tree, row_number() over "
        "(partition by source order by doc_id nulls last, leaf) - 1 as i, "
        "count(*) over (partition by source) as n from leaves)",
        "s0 as (select tree, i, n, leaf as node from placed)",
    ]

    def tree(name: str) -> str:
        for k in range(levels):
            ctes.append(
                f"{name}{k + 1} as (select tree, i // 16 as i, (n + 15) // 16 as n, "
                f"sha256(string_agg(node, '' order by i)) as node from {name}{k} where n > 1 group by tree, i // 16, n)"
            )
            sides = " , ".join(
                f"coalesce(string_agg(node, '') over (partition by tree, i // 16 order by i rows between {span}), '') as {side}"
                for side, span in (
                    ("before", "unbounded preceding and 1 preceding"),
                    ("after", "1 following and unbounded following"),
                )
            )
            ctes.append(f"{name}{k}_sides as (select tree, i, {sides} from {name}{k} where n > 1)")
        found = " union all ".join(f"select tree, node from {name}{k} where n = 1" for k in range(levels + 1))
        ctes.append(f"{name}_roots as ({found})")
        return f"{name}_roots"

    subroots = tree("s")
    ctes.append(
        f"t0 as (select 'all' as tree, row_number() over (order by tree) - 1 as i, count(*) over () as n, "
        f"node, tree as name from {subroots})"
    )
    roots = tree("t")
    ctes.append(
        "f0 as (select p.*, q.i as j, q.node as subroot, '' as proof, "
        "case when tampered then altered else leaf end as fold from placed p join t0 q on p.tree = q.name)"
    )
    steps = [("s", "f.tree", "f.i", k) for k in range(levels)] + [("t", "'all'", "f.j", k) for k in range(levels)]
    for no, (name, of, at, k) in enumerate(steps):
        ctes.append(
            f"f{no + 1} as (select f.* exclude (proof, fold), proof || coalesce(before || after, '') as proof, "
            f"case when x.tree is null then fold else sha256(before || fold || after) end as fold "
            f"from f{no} f left join {name}{k}_sides x on x.tree = {of} and x.i = {at} // {16**k})"
        )
    return (
        "with " + ",\n".join(ctes) + f"\nselect doc_id, leaf, subroot, r.node as root, sha256(proof) as proof_sha256, "
        f"fold as folded_root, fold = r.node as verified from f{len(steps)}, {roots} r"
    )


ORACLE["op12_prove_documents"] = merkle_twin(TWIN_LEVELS)


@query
def op13_align_tokens(spark, sf_dir):
    """Groups and links of two tokenizers' tokens in every whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align(
        docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    )
