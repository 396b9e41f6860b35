"""The queries of this subpackage, opN_<name>, over whole tables."""

from loomcell.llm import mtree
from loomcell.llm.langid import op8_langid
from loomcell.llm.licenses import op5_licenses
from loomcell.llm.mixing import op1_mixing
from loomcell.llm.packing import op3_packing
from loomcell.llm.pii import op10_pii
from loomcell.llm.quality import op2_quality
from loomcell.llm.simhash import op6_simhash
from loomcell.llm.substring import op7_substring
from loomcell.llm.tokencount import op4_tokencount

QUERIES = {
    f.__name__: f
    for f in (op1_mixing, op2_quality, op3_packing, op4_tokencount, op5_licenses, op6_simhash, op7_substring, op8_langid, mtree.op9_mtree, op10_pii)
}
#: The other methods cannot be written in SQL as they stand; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op9_mtree": mtree.ORACLE}
