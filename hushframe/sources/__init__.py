"""Line and HTTP sources and sinks."""
