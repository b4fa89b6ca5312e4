"""Training-data operators: token counts, quality, deduplication, scans, scoring, packing.

Nothing outside this folder (and `corpus_pipeline.py`, which belongs to it) imports it.
Rules that hold for every operator here:

* inputs are read by exact column name through `common.pick`, so extra columns, also ones
  whose names clash with internal names or differ in case only, never interfere;
* a null text is an empty text; tables may be empty; rows may repeat;
* nothing unbounded is collected: only tables of a stated maximal size reach the driver.
"""
