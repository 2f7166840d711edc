"""The registered queries of this folder and the SQL that checks them."""

from docfields.llm import blocks, chains, credentials, language, mixing, pieces, polytope, resampling, setsketch, spelling, template, toxicity, warc

QUERIES = {
    "op1_substring_dedup": chains.op1_substring_dedup,
    "op2_nearest": blocks.op2_nearest,
    "op3_minhash_near_dedup": setsketch.op3_minhash_near_dedup,
    "op4_embedding_near_dedup": polytope.op4_embedding_near_dedup,
    "op5_language": language.op5_language,
    "op6_mixing": mixing.op6_mixing,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_sentencepiece": pieces.op8_sentencepiece,
    "op9_secret_scan": credentials.op9_secret_scan,
    "op10_main_text": template.op10_main_text,
    "op11_importance_resampling": resampling.op11_importance_resampling,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_warc": warc.op13_warc,
}

ORACLES = {
    "op2_nearest": blocks.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op11_importance_resampling": resampling.ORACLE,
    "op12_spelling_variants": spelling.ORACLE,
    "op13_warc": warc.ORACLE,
}
