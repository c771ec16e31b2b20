"""The training-data operators over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from campanile.llm.archives import read_archives, resolved, write_archives
from campanile.llm import lm_scoring, toxicity
from campanile.llm.common import WORD, held_out, shared_folder, vocabulary
from campanile.llm.dart_minhash import near_duplicates
from campanile.llm.line_frequency import drop_boilerplate, lines_of
from campanile.llm.packing import pack_documents
from campanile.llm.periodic import periodic_runs
from campanile.llm.phrases import collocations
from campanile.llm.pieces import decode, encode
from campanile.llm.quality import cascade
from campanile.llm.registry import QUERIES, TWINS, query, table  # noqa: F401  the entry file reads both
from campanile.llm.sharding import contiguous_shards
from campanile.llm.token_counts import count_tokens
from campanile.llm.winnowing import digest, edited_likeness


@query("op4_token_counts")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))


@query("op10_quality_rules")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    judged = cascade(table(spark, folder, "documents"), metrics=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])
    return judged.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


@query("op7_warc_revisits", sql="""
    with p as (select page_id, coalesce(html, '') payload from pages),
         d as (select page_id, octet_length(encode(payload))::bigint payload_bytes, upper(sha1(payload)) hex, min(page_id) over (partition by payload) first_id from p),
         b as (select *, [substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, (5 * (i // 4) + 1)::int, 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int, 1) for i in range(32)] digits from d)
    select page_id, payload_bytes, array_to_string(digits, '') payload_digest, case when page_id = first_id then 'response' else 'revisit' end record_type,
           case when page_id <> first_id then first_id end refers_to
    from b
""")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    archives = shared_folder(spark, "warc")
    write_archives(table(spark, folder, "pages"), archives)
    return resolved(read_archives(spark, archives, payload=False))


@query("op8_line_dedup", sql=r"""
    with p as (select doc_id, coalesce(source, '') host, string_split(coalesce(text, ''), chr(10)) lines from documents),
         u as (select distinct host, lines from p),
         l as (select host, line, count(*) k from (select host, unnest(list_distinct([x for x in lines if regexp_matches(x, '[^\x20\x09-\x0D]')])) line from u) group by all),
         t as (select host, count(*) n from u group by host),
         b as (select l.host, list(line) gone from l join t using (host) where k >= 2 and k > 0.05 * n and (k >= 4 or k > 0.5 * n) group by l.host),
         c as (select doc_id, lines, case when gone is null then lines else [x for x in lines if not list_contains(gone, x)] end kept from p left join b using (host))
    select doc_id, len(lines)::int n_lines, (len(lines) - len(kept))::int n_dropped_lines, length(array_to_string(kept, chr(10)))::int n_chars, md5(array_to_string(kept, chr(10))) text_md5
    from c
""")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    clean = drop_boilerplate(docs.withColumn("n_lines", F.size(lines_of(F.col("text")))))
    return clean.select("doc_id", "n_lines", "n_dropped_lines", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("op3_winnowing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = edited_likeness(table(spark, folder, "documents"))
    names = [digest(F.col(c)).alias(c) for c in ("fingerprint", "edited_fingerprint")]
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *names, "near_edited", "near_next")


@query("op5_packing")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))


@query("op6_near_duplicates")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


@query("op2_toxicity")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.train(docs, labels, usable=~held_out("doc_id", 0))
    return toxicity.score(docs, model).select("doc_id", held_out("doc_id", 0).alias("held_out"), "score", "predicted")


@query("op9_lm_scoring")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    held = held_out("doc_id", 1)
    scores = lm_scoring.score(table(spark, folder, "documents"), ~held, vocabulary("byte_bpe_50k.tiktoken"))
    return scores.withColumn("held_out", held)


@query("op1_sentencepiece")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    path = vocabulary("piece_bpe_32k.model")
    encoded = encode(table(spark, folder, "documents"), path, carry=("doc_id", "text"))
    both = decode(encoded, path, carry=("doc_id", "text", "ids"))
    # the file's sign for a space is itself read as one
    same = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), "▁", " ")
    return both.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), same.alias("round_trip"))


#: CRC-32 of the bytes in the list B as DuckDB SQL.
CRC32_SQL = "(xor(4294967295, list_reduce([4294967295::bigint] || B, lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))))"
ID_CRC_SQL = CRC32_SQL.replace("B", "[ord(x)::bigint for x in string_split(doc_id::varchar, '')]")


def looped(words: Column, h: Column) -> Column:
    """The words, of which those from a = g % n on go on by repeating the p from there; g is h // 10, p follows from g and what is left."""
    g = F.floor(h / 10)
    cuts = F.transform(F.array(words), lambda w: F.struct(w.alias("w"), (g % F.size(w)).cast("int").alias("a"), F.size(w).alias("n")))
    cuts = F.transform(cuts, lambda x: F.struct(x["w"], x["a"], x["n"], (1 + F.floor((x["n"] - x["a"]) / (3 + g % 8))).cast("int").alias("p")))
    made = F.transform(cuts, lambda x: F.concat(F.slice(x["w"], F.lit(1), x["a"]), F.transform(F.sequence(x["a"], x["n"] - 1), lambda i: F.get(x["w"], x["a"] + (i - x["a"]) % x["p"]))))
    return made[0]


@query("op12_periodic_runs", sql=rf"""
    with t as (select doc_id, [w for w in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if w <> ''] w, {ID_CRC_SQL} h from documents),
         c as (select doc_id, w, h, len(w) n, (h // 10) % len(w) a, 1 + (len(w) - (h // 10) % len(w)) // (3 + (h // 10) % 8) p from t),
         d as (select doc_id, n, case when h % 10 = 0 and n > 0 then [case when i < a then w[i + 1] else w[a + (i - a) % p + 1] end for i in range(n)] else w end w from c),
         u as (select doc_id, n, unnest(w) word, unnest(range(n)) i from d),
         pairs as (select x.doc_id, x.i, y.i - x.i q from u x join u y using (doc_id, word) where y.i > x.i and 3 * (y.i - x.i) <= x.n),
         island as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) g from pairs),
         stretch as (select doc_id, q, min(i) s, count(*) + q m from island group by doc_id, q, g having count(*) + q >= greatest(24, 3 * q)),
         runs as (select doc_id, s, m, min(q) q from stretch group by all),
         told as (select doc_id, count(*) n_runs, string_agg(s || ',' || m || ',' || q || chr(10), '' order by s, q) told, arg_min({{'s': s, 'm': m, 'q': q}}, {{'e': -m / q, 's': s, 'q': q}}) best from runs group by doc_id),
         gone as (select distinct doc_id, unnest(range(s + q, s + m)) i from runs),
         kept as (select doc_id, string_agg(word, ' ' order by i) kept from u anti join gone using (doc_id, i) group by doc_id)
    select d.doc_id, coalesce(n_runs, 0) n_runs, best.s as start, best.m as length, best.q as period, 1000 * best.m // best.q exponent_milli,
           sha256(coalesce(told, '')) runs_sha256, sha256(coalesce(kept, '')) collapsed_sha256
    from d left join told using (doc_id) left join kept using (doc_id)
""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    docs = table(spark, folder, "documents").withColumn("text", F.when((h % 10 == 0) & F.col("text").rlike(WORD.pattern), F.array_join(looped(words, h), " ")).otherwise(F.col("text")))
    found = periodic_runs(docs)
    told = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    none = F.get("runs", F.lit(0))
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), none, lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, best).alias("best"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select(
        "doc_id", "n_runs", *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


@query("op11_sharding", sql=rf"""
    with d as (select doc_id, coalesce(text, '') as text from documents),
         k as (select doc_id, octet_length(encode(text))::bigint + 1 size, sha256(text) g, {CRC32_SQL.replace("B", "[('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::bigint for i in range(octet_length(encode(text)))]")} text_crc32 from d),
         o as (select *, (sum(size) over (order by g, doc_id rows unbounded preceding) - size)::bigint before from k),
         b as (select list(z order by z) b, max(z) total from (select min(before) z from o group by g union all select sum(size)::bigint from o)),
         search as (with recursive s(lo, hi) as (select (total + 7) // 8, total from b union all
             select case when list_reduce([0::bigint] || range(8), lambda p, k: list_max([x for x in b if x <= p + (lo + hi) // 2])) = total then lo else (lo + hi) // 2 + 1 end,
                    case when list_reduce([0::bigint] || range(8), lambda p, k: list_max([x for x in b if x <= p + (lo + hi) // 2])) = total then (lo + hi) // 2 else hi end
             from s, b where lo < hi) select min(hi) cap from s),
         r as (select b, total, cap, list_reduce([[total]] || [[k] for k in range(8)], lambda r, k: r || [list_min([x for x in b if x >= r[-1] - cap])]) latest from b, search),
         e as (select list_reduce([[0::bigint]] || [[k] for k in range(8, 0, -1)], lambda c, k: c || [coalesce(
             list_min([{{'off': abs(x - c[-1] - (total - c[-1]) // k[1]), 'x': x}} for x in b if x > c[-1] and x <= c[-1] + cap and x >= latest[k[1]]]).x, total)]) ends from r),
         p as (select doc_id, size, text_crc32, g, len([x for x in ends[2:8] if x <= before])::int shard from o, e)
    select doc_id, size, text_crc32, 'bytes' law, shard, row_number() over (partition by shard order by g, doc_id) - 1 slot, null::int grown_shard
    from p
""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    placed = contiguous_shards(docs, carry=("doc_id", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op13_collocations", sql=r"""
    with p as (select coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece from documents),
         w as (select lang, [x for x in string_split_regex(piece, '[\x20\x09]+') if x <> ''] w from p),
         g as (select lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) phrase from w, (select unnest([1, 2, 3, 4]) k)),
         f as (select lang, k, phrase, count(*) f from g group by all),
         n as (select lang, sum(f)::bigint n from f where k = 1 group by lang),
         c as (select lang, k, phrase, f a, string_split(phrase, ' ') x from f where k > 1 and f >= 30),
         j as (select lang, k, phrase, a, unnest(range(1, k)) j, x from c),
         s as (select j.lang, j.k, j.phrase, a, arg_min({'l': l.f, 'r': r.f, 'score': 2000000::hugeint * a // (l.f + r.f)}, {'s': 2000000::hugeint * a // (l.f + r.f), 'j': j}) best
               from j join f l on l.lang = j.lang and l.phrase = array_to_string(x[:j], ' ') join f r on r.lang = j.lang and r.phrase = array_to_string(x[j + 1:], ' ') group by all),
         inner_part as (select lang, a, unnest(list_distinct(flatten([[array_to_string(x[i:i + m - 1], ' ') for i in range(1, k - m + 2)] for m in range(2, k)]))) phrase from c),
         covered as (select distinct lang, s.phrase from s join inner_part i using (lang, phrase) where 100 * i.a >= 80 * s.a),
         o as (select lang, row_number() over (partition by lang order by best.score desc, a desc, phrase) as rank, phrase, a, best.l as l, best.r as r, best.score::bigint score from s anti join covered using (lang, phrase))
    select lang, rank, phrase, a, l, r, n, score from o join n using (lang) where rank <= 2000
""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))
