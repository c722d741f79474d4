"""DataFrame operators over detections, intervals, frames, vectors and manifests."""
