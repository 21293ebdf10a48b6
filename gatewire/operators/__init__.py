"""DataFrame-to-DataFrame steps; each works on batches and inside ``foreachBatch`` alike."""
