"""Line scoring as Structured Streaming queries."""
