"""The queries of this subpackage, and the SQL of those that SQL can express."""

from . import decontaminate, html, jpeg, lm, packing, quality, secrets, simhash, tokens, toxicity

_ALL = (
    toxicity.op1_noisy_channel_toxicity, quality.op2_bradley_terry_quality, tokens.op3_elias_fano_ids, packing.op4_swap_packing, simhash.op5_simhash_near_dedup,
    secrets.op6_secret_scan, jpeg.op7_jpeg_media, html.op8_max_subsequence_text, decontaminate.op9_winnow_decontaminate, lm.op10_deleted_interpolation,
)
QUERIES = {f.__name__: f for f in _ALL}
SQL = {"op9_winnow_decontaminate": decontaminate.SQL}
