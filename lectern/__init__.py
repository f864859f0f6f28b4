"""lectern: document analytics and retrieval expressed as DataFrame plans."""
