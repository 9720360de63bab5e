"""End-to-end plans give the same result under 1, 4 and 16 input partitions."""

from draftkit.plans import prepare as P

SF = "/root/testdata/sf0.001"


def test_flagship_and_prepare_partition_invariant(spark):
    conv = spark.read.parquet(f"{SF}/conversations.parquet")
    vocab, samples = [], []
    for n in (1, 4, 16):
        c = conv.repartition(n)
        vocab.append(sorted(tuple(r) for r in P.draft_vocabulary(c, "chatml", 256, 64).collect()))
        samples.append(sorted((r["conv_id"], tuple(r["input_ids"]), tuple(r["loss_mask"]))
                              for r in P.prepared_samples(c, "chatml", 128).collect()))
    assert vocab[0] == vocab[1] == vocab[2] and len(vocab[0]) == 64
    assert samples[0] == samples[1] == samples[2] and samples[0]
