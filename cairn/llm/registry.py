"""All queries of this subpackage with their SQL."""

from cairn.llm import align, bpe, decontam, html, langid, lm, merkle, minhash, nearest, pieces, substrings, toxicity, warc

QUERIES, SQL = {}, {}
for module in (html, toxicity, minhash, substrings, langid, nearest, lm, decontam, warc, bpe, align, merkle, pieces):
    QUERIES |= module.QUERIES
    SQL |= module.SQL
