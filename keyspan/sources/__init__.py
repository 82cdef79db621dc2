"""Where rows come from: file trees, blobs, archives, pinned fetches, package indexes."""
