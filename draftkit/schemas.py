"""Every schema in one place.  Readers always pass a schema: optional turn keys
make JSON inference unstable."""

from __future__ import annotations

from pyspark.sql import types as T

TOOL_CALL = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("function", T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("arguments", T.StringType()),
    ])),
])

# One content part of a multimodal turn.
PART = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("base64", T.StringType()),
    T.StructField("image", T.StringType()),
    T.StructField("video", T.StringType()),
    T.StructField("audio", T.StringType()),
])

# A raw turn as found in chat corpora.  A turn's content is either a text
# (``value`` or ``content``) or a list of parts (``parts``); which of the two
# it is comes from the JSON value's type when the file is read, never from
# the look of the text.
RAW_TURN = T.StructType([
    T.StructField("from", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("tool_calls", T.ArrayType(TOOL_CALL)),
    T.StructField("tool_call_id", T.StringType()),
    T.StructField("thinking", T.StringType()),
    T.StructField("reasoning_content", T.StringType()),
    T.StructField("parts", T.ArrayType(PART)),
])

RAW_CONVERSATION = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("conversations", T.ArrayType(RAW_TURN)),
    T.StructField("messages", T.ArrayType(RAW_TURN)),
])

# The same as it stands in a JSON file: ``value`` and ``content`` keep their
# JSON types as variants (``sources.readers`` turns them into RAW_TURN).
JSON_TURN = T.StructType([
    T.StructField(f.name, T.VariantType() if f.name in ("value", "content") else f.dataType)
    for f in RAW_TURN.fields if f.name != "parts"])
JSON_CONVERSATION = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("conversations", T.ArrayType(JSON_TURN)),
    T.StructField("messages", T.ArrayType(JSON_TURN)),
])

# A normalised turn.
TURN = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("parts", T.ArrayType(PART)),
    T.StructField("tool_calls", T.ArrayType(TOOL_CALL)),
    T.StructField("tool_call_id", T.StringType()),
    T.StructField("thinking", T.StringType()),
    T.StructField("reasoning_content", T.StringType()),
])

# Flat turn rows as in the ``conversations`` table.
TURN_ROW = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()),
])

PREPARED = T.StructType([
    T.StructField("sample_idx", T.LongType()),
    T.StructField("input_ids", T.ArrayType(T.IntegerType())),
    T.StructField("loss_mask", T.ArrayType(T.BooleanType())),
    T.StructField("seq_len", T.IntegerType()),
])

TOKEN_FREQ = T.StructType([
    T.StructField("token_id", T.IntegerType()),
    T.StructField("freq", T.LongType()),
])

# Regenerated response row (JSON sink).
RESPONSE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("conversations", T.ArrayType(T.StructType([
        T.StructField("from", T.StringType()),
        T.StructField("value", T.StringType()),
    ]))),
    T.StructField("metadata", T.StructType([
        T.StructField("idx", T.LongType()),
        T.StructField("finish_reason", T.StringType()),
        T.StructField("latency_s", T.DoubleType()),
        T.StructField("endpoint", T.StringType()),
        T.StructField("reasoning_content", T.StringType()),
        T.StructField("error", T.StringType()),
    ])),
])

# Benchmark result JSON of a load generator: one document per run.  Stats
# sit under ``successful``; the strategy is an object with ``type_``.
_STATS = T.StructType([T.StructField("successful", T.StructType([
    T.StructField("mean", T.DoubleType()),
    T.StructField("median", T.DoubleType()),
    T.StructField("sum", T.DoubleType()),
]))])
BENCH_RESULT = T.StructType([
    T.StructField("args", T.StructType([
        T.StructField("data_args", T.ArrayType(T.StructType([T.StructField("data_files", T.StringType())]))),
    ])),
    T.StructField("benchmarks", T.ArrayType(T.StructType([
        T.StructField("config", T.StructType([
            T.StructField("strategy", T.StructType([
                T.StructField("type_", T.StringType()),
                T.StructField("rate", T.DoubleType()),
            ])),
        ])),
        T.StructField("metrics", T.StructType([
            T.StructField("requests_per_second", _STATS),
            T.StructField("request_latency", _STATS),
            T.StructField("time_to_first_token_ms", _STATS),
            T.StructField("inter_token_latency_ms", _STATS),
            T.StructField("output_tokens_per_second", _STATS),
            T.StructField("output_tokens", _STATS),
        ])),
        T.StructField("requests", T.StructType([
            T.StructField("successful", T.ArrayType(T.StructType([
                T.StructField("output_tokens", T.LongType())]))),
        ])),
    ]))),
])

# Sweep CSV columns, in file order (acceptance columns may
# follow; missing values read as NULL).
SWEEP_COLUMNS = [
    "subset", "strategy", "target_rate", "rps_median", "latency_median_s",
    "itl_median_ms", "ttft_median_ms", "output_tps_median", "total_output_tokens",
]
