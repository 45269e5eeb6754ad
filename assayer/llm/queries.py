"""All registered queries over the corpus."""

from assayer.llm.common import ORACLES, QUERIES  # noqa: F401
from assayer.llm import (  # noqa: F401
    decontamination, hardnegatives, langid, licenses, mixing, passages, quality, sharding, similarity, tokencount, tokenfiles, toxicity,
    whitening,
)
