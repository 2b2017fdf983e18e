"""Where rows come from: sharded files, MDS folders; rows in memory are in ``dataset``."""
